"""Sinks and keyed changes."""

from ...operators import mutate
from ...operators.coerce import row_text, to_store
from ...schema import TableDef
from ...session import scratch
from ...sources import replay
from ...streaming import KeyedSink, LinesSink, ParquetSink, bind_columns, drain, fan_out
from ..pipeline import Pipeline
from .base import F, cents, checked, number, table


@checked("""
    SELECT o_orderkey || ',' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE o_orderstatus END || ',' ||
           CAST(o_totalprice AS VARCHAR) || ',' || CAST(o_orderdate AS VARCHAR) AS line
    FROM orders
""")
def sink_mkstring(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_totalprice", "o_orderdate")
    return rows.select(row_text(rows).alias("line"))


@checked("SELECT o_totalprice AS p1, o_orderkey AS p2, o_custkey AS p3, o_orderkey AS p4 FROM orders")
def sink_bind(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return bind_columns(rows, "replace into t values (${2}, ${o_orderkey}, ${1}, ${0})")


@checked("""
    SELECT coalesce(t.o_custkey, b.o_custkey) AS o_custkey, coalesce(t.cnt, 0) + coalesce(b.cnt, 0) AS cnt,
           CAST(coalesce(t.total, 0) + coalesce(b.total, 0) AS DOUBLE) AS total
    FROM (SELECT o_custkey, count(*) AS cnt, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders
          WHERE o_orderstatus = 'F' GROUP BY o_custkey) t
    FULL JOIN (SELECT o_custkey, count(*) AS cnt, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders
          WHERE o_orderstatus <> 'F' GROUP BY o_custkey) b ON t.o_custkey = b.o_custkey
""")
def sink_accumulate(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.lit(1).cast("bigint").alias("cnt"), cents("o_totalprice").alias("total"), "o_orderstatus")
    target = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        F.sum("cnt").alias("cnt"), F.sum("total").alias("total"))
    batch = orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    out = mutate.accumulate(target, batch, ["o_custkey"], ["cnt", "total"])
    return out.select("o_custkey", "cnt", number(F.col("total")).alias("total"))


def _target(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_totalprice")


def _changes(spark, sf):
    """Two rounds of price changes; orders above 400000 are in both."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.col("o_totalprice")
    first = orders.filter(price > 250000).withColumn("o_totalprice", F.round(price + 1, 2)).withColumn("seq", F.lit(1))
    second = orders.filter(price > 400000).withColumn("o_totalprice", F.round(price + 2, 2)).withColumn("seq", F.lit(2))
    return first.unionByName(second)


NEWEST = "round(o_totalprice + CASE WHEN o_totalprice > 400000 THEN 2 ELSE 1 END, 2)"


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice + 1, 2) FROM orders
    WHERE o_orderstatus = 'P' AND o_totalprice > 250000
""")
def mutate_insert(spark, sf):
    return mutate.insert_new(_target(spark, sf), _changes(spark, sf), ["o_orderkey"], ["seq"])


@checked(f"""
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 250000 THEN {NEWEST} ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 250000
""")
def mutate_upsert(spark, sf):
    return mutate.upsert(_target(spark, sf), _changes(spark, sf), ["o_orderkey"], ["seq"])


@checked(f"""
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 250000 THEN {NEWEST} ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'P'
""")
def mutate_update(spark, sf):
    return mutate.update(_target(spark, sf), _changes(spark, sf), ["o_orderkey"], ["seq"])


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <= 250000
""")
def mutate_delete(spark, sf):
    return mutate.delete(_target(spark, sf), _changes(spark, sf), ["o_orderkey"])


@checked("""
    SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) // 1000 AS ts, CAST(user_id AS INTEGER) AS user_id, value,
           CAST(NULL AS DOUBLE) AS score, props
    FROM events
""")
def sink_coerce(spark, sf):
    rows = table(spark, sf, "events").withColumn("score", F.lit(None))
    return to_store(rows, {"event_id": "string", "ts": "bigint", "user_id": "int", "value": "double",
                           "score": "double", "props": "string"})


@checked("SELECT event_id || ',' || user_id || ',' || CASE WHEN event_type = 'view' THEN 'null' ELSE event_type END AS value FROM events")
def sink_foreach(spark, sf):
    sink = LinesSink(scratch(spark, "lines"))
    rows = replay(spark, sf, "events").select("event_id", "user_id", F.expr("nullif(event_type, 'view')"))
    drain(rows, sink, scratch(spark, "lines-state"))
    return sink.read(spark)


@checked("""
    SELECT 'counts' AS sink, event_type AS name, count(*) AS n FROM events GROUP BY event_type
    UNION ALL SELECT 'errors', CAST(event_id AS VARCHAR), user_id FROM events WHERE event_type = 'error'
""")
def sink_fanout(spark, sf):
    counts, errors = ParquetSink(scratch(spark, "counts")), ParquetSink(scratch(spark, "errors"))
    both = fan_out([
        (lambda batch: batch.groupBy("event_type").agg(F.count("*").alias("n")), counts),
        (lambda batch: batch.filter("event_type = 'error'").select("event_id", "user_id"), errors),
    ])
    drain(replay(spark, sf, "events"), both, scratch(spark, "fanout-state"))
    totals = counts.read(spark).groupBy("event_type").agg(F.sum("n").alias("n"))
    return totals.select(F.lit("counts").alias("sink"), F.col("event_type").alias("name"), "n").unionByName(
        errors.read(spark).select(F.lit("errors").alias("sink"), F.col("event_id").cast("string").alias("name"),
                                  F.col("user_id").alias("n")))


@checked("SELECT event_id AS id, CAST(NULL AS VARCHAR) AS note, event_type AS kind FROM events")
def sink_contract(spark, sf):
    job, sink = Pipeline(spark), ParquetSink(scratch(spark, "contract"))
    job.source(TableDef("feed", [("event_id", "bigint"), ("event_type", "varchar")]), replay(spark, sf, "events"))
    job.sink(TableDef("out", [("id", "bigint"), ("note", "varchar"), ("kind", "varchar")]), sink)
    job.insert_into("out", "SELECT event_id, NULL, event_type FROM feed")
    job.run()
    return sink.read(spark)


@checked("""
    SELECT event_id, 1 AS run, event_type AS kind FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, 1, 'other' FROM events WHERE event_type <> 'click'
    UNION ALL SELECT o_orderkey, 1, 'order' FROM orders
    UNION ALL SELECT event_id, 2, event_type FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, 2, 'other' FROM events WHERE event_type <> 'click'
    UNION ALL SELECT o_orderkey, 2, 'order' FROM orders
""")
def sink_two_inserts(spark, sf):
    # Two streams and a batch into one table, and the same once more from fresh checkpoints.
    sink = ParquetSink(scratch(spark, "shared"))
    for run in (1, 2):
        job = Pipeline(spark)
        job.source(TableDef("feed", [("event_id", "bigint"), ("event_type", "varchar")]), replay(spark, sf, "events"))
        job.batch_table("some_orders", table(spark, sf, "orders").select("o_orderkey"))
        job.sink(TableDef("out", [("event_id", "bigint"), ("run", "int"), ("kind", "varchar")], options={"name": "both"}),
                 sink)
        job.insert_into("out", f"SELECT event_id, {run}, event_type FROM feed WHERE event_type = 'click'")
        job.insert_into("out", f"SELECT event_id, {run}, 'other' FROM feed WHERE event_type <> 'click'")
        job.insert_into("out", f"SELECT o_orderkey, {run}, 'order' FROM some_orders")
        job.run()
    return sink.read(spark)


def _keyed(spark, sf, change):
    """Price changes in several micro-batches, every one written twice, into a keyed table."""
    sink = KeyedSink(scratch(spark, change), ["o_orderkey"], ["seq"], change, start=_target(spark, sf),
                     types={"o_totalprice": "double"})

    class Twice(KeyedSink):
        def __init__(self):
            pass

        def for_writer(self, writer):
            self.inner = sink.for_writer(writer)
            return self

        def write(self, batch, batch_id):
            self.inner.write(batch, batch_id)
            self.inner.write(batch, batch_id)

    feed, state = scratch(spark, "changes"), scratch(spark, "state")
    changes = _changes(spark, sf)
    for seq in (1, 2):
        part = changes.filter(F.col("seq") == seq)
        part.write.mode("append").parquet(feed)
        drain(spark.readStream.schema(part.schema).parquet(feed), Twice(), state)
    return sink.read(spark)


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice + 1, 2) FROM orders
    WHERE o_orderstatus = 'P' AND o_totalprice > 250000
""")
def stream_insert(spark, sf):
    return _keyed(spark, sf, "insert")


@checked(f"""
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 250000 THEN {NEWEST} ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 250000
""")
def stream_upsert(spark, sf):
    return _keyed(spark, sf, "upsert")


@checked(f"""
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 250000 THEN {NEWEST} ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'P'
""")
def stream_update(spark, sf):
    return _keyed(spark, sf, "update")


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <= 250000
""")
def stream_delete(spark, sf):
    return _keyed(spark, sf, "delete")
