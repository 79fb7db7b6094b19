"""Keyed state on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.registry import Accumulator, accumulator


def dedup(stream: DataFrame, keys: Sequence[str], ways: int = 0) -> DataFrame:
    """First row per key among rows no further apart than the watermark delay of ``stream``.

    With ``ways``, copies are dropped in so many parts of each key first, by
    the task that read them, so that many copies of one message do not all
    reach the task of that key. That costs a second shuffle and state, and
    pays only where single messages come in very many copies.
    """
    if not ways:
        return stream.dropDuplicatesWithinWatermark(list(keys))
    part = F.pmod(F.spark_partition_id(), F.lit(ways))
    once = stream.withColumn("__part", part).dropDuplicatesWithinWatermark([*keys, "__part"])
    return once.drop("__part").dropDuplicatesWithinWatermark(list(keys))


def running_state(stream: DataFrame, keys: Sequence[str], spread: str, acc: str | Accumulator,
                  values: Sequence[str], ways: int = 8, ttl_ms: int | None = None) -> DataFrame:
    """Running accumulator state per key and part, emitted whenever it changes.

    Rows of a key are split into ``ways`` parts by a hash of ``spread``; the
    parts' states merge when read. On a stream with a watermark, a key
    loses its state once the watermark is ``ttl_ms`` beyond where it was at
    the key's last row; without a time-to-live states stay.
    """
    acc = accumulator(acc)
    keys, values = list(keys), list(values)
    groups = [*keys, "part"]
    key_ddl = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    fields = [piece.split()[0] for piece in acc.state.split(",")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current = state.get if state.exists else acc.zero()
        for batch in batches:
            current = acc.add(current, batch[values])
        state.update(tuple(current))
        if ttl_ms:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + ttl_ms)
        yield pd.DataFrame([(*key, *current)], columns=[*groups, *fields])

    part = F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int").alias("part")
    # the watermark's column has to be there for timeouts by it
    marked = [f.name for f in stream.schema if "spark.watermarkDelayMs" in f.metadata and f.name not in values] \
        if ttl_ms else []
    return (
        stream.select(*keys, part, *[F.col(v) for v in [*values, *marked] if v not in keys])
        .groupBy(*groups)
        .applyInPandasWithState(step, f"{key_ddl}, part int, {acc.state}", acc.state, "update",
                                GroupStateTimeout.EventTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)
    )


