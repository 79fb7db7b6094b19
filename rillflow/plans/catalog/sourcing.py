"""Sources: topics, start positions, several origins, replay and custom readers."""

from pyspark.sql import types as T

from ...operators.decode import decode
from ...schema import Col, TableDef
from ...session import scratch
from ...sources import connect, connector, keep_from, replay, tagged_union
from ...streaming import ParquetSink, drain
from ..pipeline import Pipeline
from .base import F, checked, envelopes, table

TOPIC = TableDef("topic1", [
    Col("_topic", "varchar"), Col("_key", "varchar"), Col("_partition", "integer"), Col("_offset", "bigint"),
    Col("k", "bigint"),
])


@checked("""
    SELECT event_type AS _topic, CAST(user_id AS VARCHAR) AS _key, CAST(user_id % 4 AS INTEGER) AS _partition,
           event_id AS _offset, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events
""")
def src_envelope_decode(spark, sf):
    return decode(envelopes(table(spark, sf, "events"), F.col("props")), TOPIC)


@checked("""
    SELECT event_id AS topic, event_type AS key, json_extract_string(props, '$.k') AS value
    FROM events WHERE event_id % 7 > 0
""")
def src_envelope_origin(spark, sf):
    # The messages have fields named like the envelope's own; one in seven has no value.
    message = F.to_json(F.struct(F.col("event_id").alias("topic"), F.col("event_type").alias("key"),
                                 F.get_json_object("props", "$.k").alias("value")))
    rows = envelopes(replay(spark, sf, "events"), F.when(F.col("event_id") % 7 > 0, message))
    job, sink = Pipeline(spark), ParquetSink(scratch(spark, "origin"))
    columns = [("topic", "bigint"), ("key", "varchar"), ("value", "varchar")]
    job.source(TableDef("named_alike", columns), rows)
    job.sink(TableDef("out", columns), sink)
    job.insert_into("out", "SELECT topic, key, value FROM named_alike")
    job.run()
    return sink.read(spark)


@checked("""
    SELECT event_type AS _topic, CAST(user_id AS VARCHAR) AS _key, CAST(user_id % 4 AS INTEGER) AS _partition,
           event_id AS _offset, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events
    WHERE CASE WHEN event_type = 'click' AND user_id % 4 = 0 THEN event_id >= 2500
               WHEN event_type = 'click' AND user_id % 4 = 1 THEN false
               WHEN event_type = 'view' AND user_id % 4 = 3 THEN event_id >= 7000
               ELSE true END
""")
def src_start_offsets(spark, sf):
    start = {"click": {"0": 2500, "1": -1, "2": -2}, "view": {"3": 7000}}
    return decode(keep_from(envelopes(table(spark, sf, "events"), F.col("props")), start), TOPIC)


@checked("""
    SELECT 'hostA' AS host, CAST(7001 AS INTEGER) AS port, text AS value FROM documents
    UNION ALL
    SELECT 'hostB', CAST(7002 AS INTEGER), text FROM conversations
    UNION ALL
    SELECT 'hostC', CAST(7003 AS INTEGER), text FROM benchmark
""")
def src_union_provenance(spark, sf):
    names = {"hostA": "documents", "hostB": "conversations", "hostC": "benchmark"}
    origins = [("hostA", 7001), ("hostB", 7002), ("hostC", 7003)]
    return tagged_union(
        origins, lambda host, port: table(spark, sf, names[host]).select(F.col("text").alias("value"))
    )


@checked("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_replay(spark, sf):
    sink = ParquetSink(scratch(spark, "replay"))
    drain(replay(spark, sf, "events"), sink, scratch(spark, "replay-state"))
    return sink.read(spark)


@connector("order_feed")
def _order_feed(spark, options, schema):
    rows = table(spark, options["folder"], "orders").filter(F.col("o_orderstatus") == options["status"])
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
    FROM orders WHERE o_orderstatus = 'F'
""")
def src_custom(spark, sf):
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.DateType()),
    ])
    return connect(spark, "order_feed", {"folder": sf, "status": "F"}, schema)
