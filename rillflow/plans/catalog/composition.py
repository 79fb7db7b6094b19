"""Jobs put together from sources, views and inserts."""

from ...schema import Col, TableDef, Watermark
from ...session import scratch
from ...sources import replay
from ...streaming import ChangelogSink, ParquetSink, drain, micro_batch_sql
from ...streaming.eventtime import label
from ..pipeline import Pipeline
from .base import F, checked, envelopes, table
from .decoding import MESSAGE

TOPIC = TableDef("topic1", [
    Col("_key", "varchar"), Col("_offset", "bigint"), Col("user_id", "varchar"), Col("store", "double"),
    Col("event_time", "bigint", "$.content.event_time"),
])


def _job(spark, sf, stream=False):
    """A job whose source is the events table as JSON messages."""
    events = replay(spark, sf, "events") if stream else table(spark, sf, "events")
    job = Pipeline(spark)
    job.source(TOPIC, envelopes(events, F.expr(MESSAGE)))
    return job


@checked("SELECT user_id AS _key, value AS store FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, value FROM events) WHERE value > 100")
def q_select(spark, sf):
    return _job(spark, sf).select("SELECT _key, store FROM topic1 WHERE store > 100")


@checked("SELECT CAST(user_id AS VARCHAR) AS k, 'uid_' || user_id AS uid, event_id AS pos FROM events")
def q_insert_select(spark, sf):
    job, sink = _job(spark, sf, stream=True), ParquetSink(scratch(spark, "insert"))
    job.sink(TableDef("out", [("k", "varchar"), ("uid", "varchar"), ("pos", "bigint")]), sink)
    job.insert_into("out", "SELECT _key, user_id, _offset FROM topic1")
    job.run()
    return sink.read(spark)


@checked("""
    WITH a AS (SELECT * FROM events WHERE value > 20), b AS (SELECT user_id, count(*) AS cnt FROM a GROUP BY user_id)
    SELECT 'uid_' || user_id AS uid, cnt FROM b WHERE cnt > 3
""")
def q_cte(spark, sf):
    job, sink = _job(spark, sf), ParquetSink(scratch(spark, "cte"))
    job.sink(TableDef("out", [("uid", "varchar"), ("cnt", "bigint")]), sink)
    job.insert_into("out", """
        WITH a AS (SELECT * FROM topic1 WHERE store > 20), b AS (SELECT user_id, count(*) AS cnt FROM a GROUP BY user_id)
        SELECT user_id, cnt FROM b WHERE cnt > 3
    """)
    job.run()
    return sink.read(spark)


@checked("""
    SELECT uid, count(*) AS cnt, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (SELECT 'uid_' || user_id AS uid, value FROM events WHERE event_type <> 'error') GROUP BY uid
""")
def q_view(spark, sf):
    job = _job(spark, sf)
    job.source(TableDef("plain", [("event_type", "varchar"), ("user_id", "bigint"), ("value", "double")]),
               table(spark, sf, "events"))
    job.view("valid", "SELECT concat('uid_', user_id) AS uid, value FROM plain WHERE event_type <> 'error'")
    job.view("totals", """SELECT uid, count(*) AS cnt, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
                          FROM valid GROUP BY uid""")
    return job.query("SELECT * FROM totals")


WINDOWED = """
    SELECT {key} AS key, count(*) AS cnt,
           strftime(w, '%Y-%m-%d %H:%M:%S') || '-;->' || strftime(w + INTERVAL {size}, '%Y-%m-%d %H:%M:%S') AS window_time
    FROM (SELECT *, time_bucket(INTERVAL {size}, ts) AS w FROM events) GROUP BY {key}, w
"""


@checked(WINDOWED.format(key="CAST(user_id AS VARCHAR)", size="1 HOUR"))
def q_view_watermark(spark, sf):
    # Results are keyed by key and window, and the newest row of each counts.
    job, sink = _job(spark, sf, stream=True), ChangelogSink(scratch(spark, "windows"), ["key", "window_time"])
    job.view("foo", "SELECT _key AS key, event_time FROM topic1", Watermark("event_time", "5 seconds"))
    job.sink(TableDef("out", [("key", "varchar"), ("cnt", "long"), ("window_time", "varchar")]), sink)
    counts = job.query("SELECT * FROM foo WHERE key IS NOT NULL").groupBy("key", F.window("rowtime", "1 hour")).agg(
        F.count("*").alias("cnt"))
    job.insert_into("out", counts.select("key", "cnt", label()))
    job.run()
    return sink.read(spark)


@checked("SELECT 'uid_' || user_id AS uid, CAST(NULL AS DOUBLE) AS store, event_id AS pos FROM events")
def q_insert_columns(spark, sf):
    job, sink = _job(spark, sf, stream=True), ParquetSink(scratch(spark, "columns"))
    job.sink(TableDef("out", [("uid", "varchar"), ("store", "double"), ("pos", "bigint")]), sink)
    job.insert_into("out", "SELECT _offset, user_id FROM topic1", columns=["pos", "uid"])
    job.run()
    return sink.read(spark)


@checked("""
    SELECT t.name, count(e.event_id) AS cnt FROM (VALUES ('click'), ('click'), ('none')) AS t(name)
    LEFT JOIN events e ON e.event_type = t.name GROUP BY t.name
""")
def q_values(spark, sf):
    # Events are counted before the join, so a frequent type meets each name as one row.
    table(spark, sf, "events").createOrReplaceTempView("values_events")
    return spark.sql("""
        SELECT t.name, coalesce(sum(e.cnt), 0L) AS cnt FROM VALUES ('click'), ('click'), ('none') AS t(name)
        LEFT JOIN (SELECT event_type, count(*) AS cnt FROM values_events GROUP BY event_type) e ON e.event_type = t.name
        GROUP BY t.name
    """)


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
    WHERE rn <= 2
""")
def q_microbatch_sql(spark, sf):
    # OVER is refused on streams; per batch it runs, and the tops of the batches are ranked once more.
    table(spark, sf, "customer").createOrReplaceTempView("lookup_customer")
    sink = ChangelogSink(scratch(spark, "microbatch"), ["o_orderkey"])
    statement = """
        SELECT o_orderkey, o_custkey, o_totalprice, rn FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
            FROM batch_orders
            WHERE NOT EXISTS (SELECT 1 FROM lookup_customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING'))
        WHERE rn <= 2
    """
    shared = micro_batch_sql("batch_orders", [(statement, sink)])
    drain(replay(spark, sf, "orders"), shared, scratch(spark, "microbatch-state"))
    ranks = sink.read(spark).drop("rn")
    ranks.createOrReplaceTempView("batch_tops")
    return spark.sql("""
        SELECT o_orderkey, o_custkey, o_totalprice, rn FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM batch_tops)
        WHERE rn <= 2
    """)
