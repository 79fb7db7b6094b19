"""Bucketed operators against plain windows, on rows where one key holds half of everything."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from rillflow.operators import (
    asof_join, distinct_set, except_rows, hot_keys, intersect_rows, interval_join, neighbours, range_join, ranked, session_totals, sliding_range,
    sliding_rows, spread_join, top_per_group,
)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    data = []
    for at in range(600):
        key = "hot" if draw.random() < 0.5 else draw.choice(["a", "b", None])
        data.append((at, key, draw.choice([draw.randrange(0, 60), draw.randrange(0, 400)]), draw.randrange(-50, 50)))
    return spark.createDataFrame(data, "id int, k string, pos bigint, v int").cache()


def same(left, right):
    columns = sorted(right.columns)
    assert sorted(map(repr, left.select(columns).collect())) == sorted(map(repr, right.select(columns).collect()))


def test_ranks(rows):
    tied = W.partitionBy("k").orderBy("pos")
    exact = W.partitionBy("k").orderBy("pos", "id")
    want = rows.select(
        "*", F.row_number().over(exact).cast("bigint").alias("row_number"), F.rank().over(tied).cast("bigint").alias("rank"),
        F.dense_rank().over(tied).cast("bigint").alias("dense_rank"),
        F.percent_rank().over(tied).alias("percent_rank"), F.ntile(7).over(exact).alias("ntile"))
    got = ranked(rows, ["k"], ["pos"], F.floor(F.col("pos") / 13), ties=["id"], tiles=7)
    same(got, want)


def test_more_tiles_than_rows(spark):
    few = spark.createDataFrame([(at, "x", at) for at in range(3)], "id int, k string, pos int")
    want = few.withColumn("ntile", F.ntile(5).over(W.partitionBy("k").orderBy("pos")))
    got = ranked(few, ["k"], ["pos"], F.col("pos"), tiles=5).select(*want.columns)
    same(got, want)


def test_neighbours(rows):
    w = W.partitionBy("k").orderBy("pos", "id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    want = rows.select("*", F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
                       F.first("v").over(whole).alias("first_value"), F.last("v").over(whole).alias("last_value"),
                       F.nth_value("v", 4).over(whole).alias("nth_value"))
    same(neighbours(rows, ["k"], ["pos", "id"], F.floor(F.col("pos") / 9), "v", nth=4), want)


@pytest.mark.parametrize("preceding", [1, 5, 40])
def test_rows_frame(rows, preceding):
    w = W.partitionBy("k").orderBy("pos", "id").rowsBetween(-preceding, 0)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("m"))
    got = sliding_rows(rows, ["k"], ["pos", "id"], F.floor(F.col("pos") / 4), "v", preceding,
                       {"s": "sum", "n": "count", "m": "min"})
    same(got, want)


def test_range_frame(spark, rows):
    holes = rows.select("id", "k", F.when(F.col("id") % 11 != 0, F.col("pos")).alias("pos"),
                        F.when(F.col("id") % 5 != 0, F.col("v")).alias("v"))
    w = W.partitionBy("k").orderBy("pos").rangeBetween(-20, 0)
    want = holes.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    for width in (7, 20, 1000):
        same(sliding_range(holes, ["k"], "pos", "v", 20, width, {"s": "sum", "n": "count"}), want)
    with pytest.raises(ValueError):
        sliding_range(rows, ["k"], "pos", "v", 20, 5, {"s": "max"})
    with pytest.raises(ValueError):
        sliding_range(rows.withColumn("v", F.lit(1.5)), ["k"], "pos", "v", 20, 5, {"s": "sum"})


def test_top_per_group_limits_before_the_shuffle(rows):
    top = top_per_group(rows, ["k"], [F.col("v").desc(), F.col("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("k").count().filter("count <> 3").count() == 0


def test_asof(rows):
    left = rows.filter("v >= 0").select("k", "id", F.timestamp_seconds("pos").alias("t"))
    right = rows.filter("v < 0").select("k", F.col("id").alias("rid"), "v", F.timestamp_seconds("pos").alias("rt"))
    pairs = left.join(right, (left.k == right.k) & (right.rt <= left.t), "left").groupBy(left.k, "id", "t").agg(
        F.max_by(F.struct("rid", "v"), F.struct("rt", "rid")).alias("hit"))
    want = pairs.select("k", "id", "t", F.col("hit.rid").alias("rid"), F.col("hit.v").alias("v"))
    got = asof_join(left, right, ["k"], "t", "rt", {"rid": "rid", "v": "v"}, 30_000, ties=["rid"])
    same(got, want)


def test_interval_and_range_joins(rows):
    left = rows.filter("v >= 20").select("k", "id", F.timestamp_seconds("pos").alias("t"))
    right = rows.filter("v < -20").select("k", F.col("id").alias("rid"), F.timestamp_seconds("pos").alias("rt"))
    want = left.join(right.withColumnRenamed("k", "rk"), F.expr(
        "k = rk and rt >= t and rt <= t + interval 25 seconds")).select("k", "id", "t", "rid", "rt")
    same(interval_join(left, right, ["k"], "t", "rt", 25_000), want)
    same(interval_join(left, right, ["k"], "t", "rt", 25_000, width_ms=4_000), want)
    bands = rows.filter("id < 40").select(F.col("id").alias("band"), F.col("pos").alias("lo"),
                                          (F.col("pos") + F.abs("v")).alias("hi"))
    points = rows.select("id", "pos")
    want = points.join(bands, F.expr("pos >= lo and pos < hi"))
    same(range_join(points, bands, "pos", "lo", "hi", 7.0), want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, rows, how):
    names = spark.createDataFrame([("hot", "H"), ("a", "A"), ("a", "A2")], "k string, name string")
    assert [r.k for r in hot_keys(rows, ["k"], 0.4).collect()] == ["hot"]
    same(spread_join(rows, names, ["k"], ways=5, share=0.4, how=how), rows.join(names, "k", how))
    with pytest.raises(ValueError):
        spread_join(rows, names, ["k"], how="full")


def test_sessions_with_hot_key(spark, rows):
    timed = rows.select("k", "v", F.timestamp_seconds("pos").alias("t"))
    w = W.partitionBy("k").orderBy("t")
    fresh = F.coalesce(F.col("t").cast("long") - F.lag(F.col("t").cast("long")).over(w) > 2, F.lit(True)).cast("int")
    want = timed.withColumn("f", fresh).withColumn("s", F.sum("f").over(w)).groupBy("k", "s").agg(
        F.min("t").alias("session_start"), (F.max("t") + F.expr("interval 2 seconds")).alias("session_end"),
        F.count("*").alias("cnt"), F.sum("v").alias("v")).drop("s")
    same(session_totals(timed, ["k"], "t", 2_000, {"v": F.col("v")}), want)


def test_distinct_set_keeps_null_last(spark):
    rows = spark.createDataFrame([("a", "y"), ("a", None), ("a", "x"), ("a", "y"), ("b", None)], "k string, v string")
    assert {r.k: r.s for r in distinct_set(rows, ["k"], "v", "s").collect()} == {"a": ["x", "y", None], "b": [None]}


def test_set_operations_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "n int, s string")
    b = spark.createDataFrame([(1, None), (3, "y"), (4, "z")], "n int, s string")
    same(intersect_rows(a, b), a.intersect(b))
    same(except_rows(a, b), a.subtract(b))


def test_interval_join_of_equal_times(spark):
    from rillflow.operators.joins import interval_join

    left = spark.sql("select 1 k, timestamp_millis(x) t from values 0, 5 as v(x)")
    right = spark.sql("select 1 k, timestamp_millis(x) u, x from values 5, 6 as v(x)")
    assert [r.x for r in interval_join(left, right, ["k"], "t", "u", 0).collect()] == [5]


def test_spread_join_cuts_null_keys(spark):
    rows = spark.range(4000).selectExpr("case when id % 10 = 0 then id end as k", "id")
    joined = spread_join(rows, spark.range(4000).selectExpr("id as k", "id * 2 as w"), ["k"], ways=16, how="left")
    assert joined.count() == 4000 and joined.where("w is not null").count() == 400
    sizes = joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 3000


def test_user_aggregate_keeps_keys_apart_and_shuffles_once(spark):
    from rillflow.functions.registry import Accumulator, aggregate_by

    class Total(Accumulator):
        state, result = "s bigint", "bigint"

        def zero(self):
            return (0,)

        def add(self, state, values):
            return (state[0] + int(values.iloc[:, 0].sum()),)

        def merge(self, left, right):
            return (left[0] + right[0],)

        def finish(self, state):
            return state[0]

    big = 2**53
    rows = spark.createDataFrame([(big, big + 1), (big + 1, 1), (None, None), (None, 5), (big, None)], "k bigint, v bigint")
    got = aggregate_by(rows, ["k"], Total(), ["v"], "s")
    assert {r.k: r.s for r in got.collect()} == {big: big + 1, big + 1: 1, None: 5}
    many = spark.range(200_000).selectExpr("id % 70000 as k", "id as v").repartition(3)
    got = aggregate_by(many, ["k"], Total(), ["v"], "s")
    assert got.count() == 70_000 and got.agg(F.sum("s")).first()[0] == sum(range(200_000))
    plan = aggregate_by(spark.range(10).selectExpr("id as k", "id as v"), ["k"], Total(), ["v"], "s")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_sliding_rows_over_many_rows(spark):
    rows = spark.range(9000).selectExpr("id % 3 as k", "id as o", "id % 7 as v")
    bucket = F.when(F.col("o") < 4000, F.floor(F.col("o") / 7)).otherwise(1000 + F.floor(F.col("o") / 2500))
    got = sliding_rows(rows, ["k"], ["o"], bucket, "v", 2000, {"total": "sum", "n": "count"})
    rows.createOrReplaceTempView("many_rows")
    want = spark.sql("""select *, sum(v) over w as total, count(v) over w as n from many_rows
                        window w as (partition by k order by o rows between 2000 preceding and current row)""")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 9000
