"""Message envelopes: the topic source and its start positions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("offset", T.LongType()),
])

# Declared option names and the reader options they become.
RENAMED = {
    "kafka_topic": "subscribe",
    "kafka_broker": "kafka.bootstrap.servers",
    "auto.offset.reset": "startingOffsets",
}

# Options a Spark topic reader sets itself and refuses.
UNSUPPORTED = {
    "kafka_group_id",
    "group.id",
    "key.deserializer",
    "value.deserializer",
    "key.serializer",
    "value.serializer",
    "enable.auto.commit",
    "interceptor.classes",
}

EARLIEST, LATEST = -2, -1


def _position(text: str) -> str:
    if text in ("earliest", "latest"):
        return text
    try:
        given = json.loads(text)
    except ValueError:
        given = None
    if not isinstance(given, dict):
        raise ValueError(f"start position {text!r}: use earliest, latest or JSON offsets per partition")
    return text


def _refused(key: str) -> bool:
    """``kafka.group.id`` is the one of them that the reader takes when it is spelled out."""
    return key.removeprefix("kafka.") in UNSUPPORTED and key != "kafka.group.id"


def kafka_options(options: dict) -> dict[str, str]:
    """Reader options for declared topic-source ``options``.

    Options that are null or that Spark manages itself are dropped, and
    everything that has no Spark name of its own is handed through.
    """
    kind = str(options.get("value_type") or "json").lower()
    if kind != "json":
        raise ValueError(f"value_type {kind!r} is not supported, only json")
    out = {}
    for key, value in options.items():
        if value is None or key == "value_type" or _refused(key):
            continue
        out[RENAMED.get(key, key)] = str(value)
    if not out.get("subscribe") or not out.get("kafka.bootstrap.servers"):
        raise ValueError("a topic source needs kafka_topic and kafka_broker")
    out["subscribe"] = ",".join(topic.strip() for topic in out["subscribe"].split(",") if topic.strip())
    out["startingOffsets"] = _position(out.get("startingOffsets", "latest"))
    return out


def kafka_source(spark: SparkSession, options: dict) -> DataFrame:
    """Stream of envelopes from Spark's topic reader."""
    stream = spark.readStream.format("kafka").options(**kafka_options(options)).load()
    return stream.select(*[F.col(f.name).cast(f.dataType) for f in ENVELOPE])


def keep_from(envelopes: DataFrame, start: str | dict) -> DataFrame:
    """Bounded replay: envelopes at or after the start position.

    ``start`` is ``earliest``, ``latest`` or ``{topic: {partition: offset}}``
    with -2 for earliest and -1 for latest. Partitions it does not name start
    at the earliest offset. The position is a literal map inside the filter,
    so the stage stays a scan without a join; its size is that of the option.
    """
    if isinstance(start, str):
        text = _position(start)
        if text == "earliest":
            return envelopes
        if text == "latest":
            return envelopes.filter(F.lit(False))
        start = json.loads(text)
    pairs = []
    for topic, offsets in start.items():
        for part, offset in offsets.items():
            first = 0 if int(offset) == EARLIEST else None if int(offset) == LATEST else int(offset)
            pairs += [F.lit(f"{topic}/{int(part)}"), F.lit(first).cast("bigint")]
    if not pairs:
        return envelopes
    starts = F.create_map(*pairs)
    slot = F.concat_ws("/", F.col("topic"), F.col("partition").cast("string"))
    named = F.map_contains_key(starts, slot)
    return envelopes.filter(~named | (F.col("offset") >= F.try_element_at(starts, slot)))
