"""Joins without an equality against all pairs, and what their plans and copies look like."""

import datetime as dt
import math
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from rillflow.operators import inequality, inequality_join, range_join
from rillflow.operators.inequality import TESTS, placed_ranges

NAN = float("nan")


def above(x):
    """NaN above all numbers."""
    return (1, 0.0) if isinstance(x, float) and math.isnan(x) else (0, x)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sample(n, seed, first):
    rng = random.Random(seed)
    values = [None, NAN, float("inf"), -float("inf"), 0.0, -0.0, *[rng.uniform(-9, 9) for _ in range(20)]]
    # a third of all rows has one value of the first column
    return [(first + i, 3.5 if rng.random() < 0.35 else rng.choice(values), rng.choice([None, *range(12)])) for i in range(n)]


@pytest.mark.parametrize(("one", "two", "block"), [("<", ">", 7), ("<=", "<=", 13), (">", ">=", 60), (">=", "<", 1000), ("<", None, 9)])
def test_pairs_of_any_conditions(spark, one, two, block):
    ours, theirs = sample(90, 1, 0), sample(70, 2, 1000)
    ours += ours[:5]
    left = spark.createDataFrame(ours, "a int, x double, p long").repartition(3)
    right = spark.createDataFrame(theirs, "b int, y double, q long")
    conditions = [("x", one, "y"), *([("p", two, "q")] if two else [])]
    got = inequality_join(left, right, conditions, block_rows=block)
    assert got.columns == ["a", "x", "p", "b", "y", "q"]
    assert "CartesianProduct" not in plan(got) and "NestedLoopJoin" not in plan(got)
    hold = lambda test, x, y: x is not None and y is not None and TESTS[test](above(x), above(y))
    # rows without a value in a column of the conditions match nothing
    want = Counter((r[0], s[0]) for r in ours for s in theirs if hold(one, r[1], s[1]) and (not two or hold(two, r[2], s[2])))
    assert Counter((r.a, r.b) for r in got.collect()) == want


@pytest.mark.parametrize(("one", "two", "block"), [("<", ">", 7), ("<=", "<=", 13), (">", ">=", 60), (">=", "<", 1000), ("<", None, 9)])
def test_counts_are_those_of_the_pairs(spark, one, two, block):
    ours, theirs = sample(90, 1, 0), sample(70, 2, 1000)
    ours += [*ours[:5], (None, 1.0, 3)]
    left = spark.createDataFrame(ours, "a int, x double, p long").repartition(3)
    right = spark.createDataFrame(theirs, "b int, y double, q long")
    conditions = [("x", one, "y"), *([("p", two, "q")] if two else [])]
    got = inequality_join(left, right, conditions, block_rows=block, counted="n")
    assert got.columns == ["a", "x", "p", "n"]
    hold = lambda test, x, y: x is not None and y is not None and TESTS[test](above(x), above(y))
    want = [(r[0], sum(hold(one, r[1], s[1]) and (not two or hold(two, r[2], s[2])) for s in theirs)) for r in ours]
    assert Counter((r.a, r.n) for r in got.collect()) == Counter(w for w in want if w[1])


def test_counts_form_no_pairs(spark):
    """60,000 rows a side have 1.8 billion pairs."""
    left = spark.range(60_000).select(F.col("id").alias("x"), F.lit("k").alias("p"))
    right = spark.range(60_000).select(F.col("id").alias("y"), F.lit("j").alias("q"))
    got = inequality_join(left, right, [("x", "<", "y"), ("p", ">", "q")], block_rows=9000, counted="n")
    assert got.where("n != 59999 - x").isEmpty() and got.count() == 59_999
    assert inequality_join(left.limit(0), right, [("x", "<", "y")], counted="n").count() == 0


def test_other_types_and_empty_sides(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    left = spark.createDataFrame([(i, day(i), Decimal(i), f"k{i % 10}é") for i in range(40)], "a int, d date, n decimal(20,3), s string")
    right = spark.createDataFrame([(i, day(2 * i), Decimal(-i), f"k{i % 7}") for i in range(30)],
                                  "b int, e date, m decimal(20,3), t string")
    got = {(r.a, r.b) for r in inequality_join(left, right, [("d", "<", "e"), ("s", ">", "t")], block_rows=8).collect()}
    assert got == {(a, b) for a in range(40) for b in range(30) if a < 2 * b and f"k{a % 10}é" > f"k{b % 7}"}
    got = {(r.a, r.b) for r in inequality_join(left, right, [("n", "<=", "m")], block_rows=8).collect()}
    assert got == {(0, 0)}
    for one, other in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        assert inequality_join(one, other, [("d", "<", "e")]).count() == 0
    with pytest.raises(ValueError, match="type"):
        inequality_join(left, right, [("d", "<", "t")])
    with pytest.raises(ValueError, match="conditions"):
        inequality_join(left, right, [("d", "=", "e")])


def test_blocks_that_can_not_meet_are_not_formed(spark):
    """Two sorted sides that overlap at one end only: most pairs of blocks are ruled out by their bounds."""
    left = spark.range(4000).select(F.col("id").alias("x"), (-F.col("id")).alias("p"))
    right = spark.range(3900, 8000).select(F.col("id").alias("y"), (-F.col("id")).alias("q"))
    got = inequality_join(left, right, [("x", ">", "y")], block_rows=100)
    assert got.count() == 99 * 100 // 2
    copies = inequality_join(left, right, [("x", ">", "y"), ("p", ">", "q")], block_rows=100)
    assert copies.count() == 0


BANDS = "band int, lo double, hi double"


def test_ranges_of_mixed_lengths(spark):
    rng = random.Random(3)
    values = [None, NAN, -1e300, 1e300, *[rng.choice([5.0, rng.uniform(-100, 100)]) for _ in range(200)]]
    ends = [(rng.uniform(-120, 100), 10 ** rng.uniform(-9, 2.3)) for _ in range(60)]
    bands = [(low, low + length) for low, length in ends] + [
        (-math.inf, math.inf), (-math.inf, 0.0), (5.0, math.inf), (7.0, 7.0), (9.0, 2.0), (None, 3.0), (3.0, None),
        (5.0, math.nextafter(5.0, 6)), (-1e6, 1e6), (2.0, NAN)]
    points = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    ranges = spark.createDataFrame([(i, *b) for i, b in enumerate(bands)], BANDS)
    want = Counter((i, b) for i, v in enumerate(values) for b, (lo, hi) in enumerate(bands)
                   if None not in (v, lo, hi) and above(lo) <= above(v) < above(hi))
    for width in (None, 0.5, 1e9):
        got = range_join(points, ranges, "v", "lo", "hi", width)
        assert Counter((r.id, r.band) for r in got.collect()) == want
        assert got.columns == ["id", "v", "band", "lo", "hi"] and "NestedLoopJoin" not in plan(got)
    assert range_join(points, ranges.limit(0), "v", "lo", "hi").count() == 0
    only = spark.createDataFrame([(1, -math.inf, math.inf)], BANDS)
    assert range_join(points, only, "v", "lo", "hi").count() == len(values) - 2


def test_one_range_over_everything_is_not_cut_small(spark):
    """Short ranges do not make a long one lie in very many cells."""
    bands = [(0, 0.0, 1e12)] + [(i, float(i), i + 1e-3) for i in range(1, 50)]
    ranges, points = spark.createDataFrame(bands, BANDS), spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert range_join(points, ranges, "v", "lo", "hi").count() == 1000 + 49
    placed = placed_ranges(ranges, "lo", "hi")[0].groupBy("band").count().collect()
    assert max(r["count"] for r in placed) <= 66 and sum(r["count"] for r in placed) <= 66 + 3 * 49


def test_whole_numbers_and_large_ones(spark):
    big = 1 << 62
    points = spark.createDataFrame([(big + i,) for i in range(-5, 6)], "v long")
    ranges = spark.createDataFrame([(1, big - 2, big + 2), (2, -big, big + 1), (3, big, big)], "band int, lo long, hi long")
    got = {(r.v - big, r.band) for r in range_join(points, ranges, "v", "lo", "hi").collect()}
    assert got == {(i, 1) for i in range(-2, 2)} | {(i, 2) for i in range(-5, 1)}


def test_packs_give_all_pairs(spark, monkeypatch):
    """Cells with few and with many ranges, packs and tasks cut everywhere, a third of the points at one value, all kinds of columns."""
    rng = random.Random(5)
    for name, size in (("DENSE", 12), ("PACKED", 7), ("DEALT", 50)):
        monkeypatch.setattr(inequality, name, size)
    day = dt.datetime(2024, 1, 1)
    values = [None, NAN, -0.0, 0.0, math.inf, -math.inf, *[5.0 if rng.random() < 0.35 else rng.uniform(-100, 100) for _ in range(300)]]
    rows = [(i, v, None if i % 5 == 0 else f"é{i % 3}", Decimal(i), day + dt.timedelta(i), [i, None], {"k": i % 2 == 0}) for i, v in enumerate(values)]
    points = spark.createDataFrame(rows + rows[:20], "id int, v double, s string, d decimal(20,3), t timestamp, a array<int>, m map<string,boolean>")
    ends = [(rng.uniform(-100, 90), length) for length in (1e-7, 3.0, 3.5, 40.0) for _ in range(60 if length > 1 else 5)]
    bands = [(low, low + length) for low, length in ends] + [
        (-math.inf, math.inf), (-math.inf, 0.0), (5.0, math.inf), (7.0, 7.0), (None, 3.0), (3.0, None), (2.0, NAN), (0.0, 5.0)]
    ranges = spark.createDataFrame([(i, *b, f"r{i}") for i, b in enumerate(bands + bands[:9])], f"{BANDS}, note string")
    levels = placed_ranges(ranges, "lo", "hi")[1]
    assert min(levels.values()) < 12 <= max(levels.values())
    want = Counter((i % len(rows), b) for i, v in enumerate(values + values[:20]) for b, (lo, hi) in enumerate(bands + bands[:9])
                   if None not in (v, lo, hi) and above(lo) <= above(v) < above(hi))
    got = range_join(points.repartition(3), ranges, "v", "lo", "hi")
    assert got.columns == [*points.columns, *ranges.columns] and "CartesianProduct" not in plan(got) and "NestedLoopJoin" not in plan(got)
    found = got.collect()
    assert Counter((r.id, r.band) for r in found) == want
    known = {r.id: str(tuple(r)) for r in points.collect()}
    assert all(str(tuple(r)[:7]) == known[r.id] and r.note == f"r{r.band}" for r in found)


def test_whole_numbers_in_packs(spark, monkeypatch):
    """Whole numbers that are one number as doubles, and decimals against them."""
    monkeypatch.setattr(inequality, "DENSE", 1)
    big = 1 << 62
    points = spark.createDataFrame([(big + i,) for i in range(-5, 6)], "v long")
    ranges = spark.createDataFrame([(1, big - 2, big + 2000), (2, -big, big + 1), (3, big, big), (4, big - 3000, big)], "band int, lo long, hi long")
    got = Counter((r.v - big, r.band) for r in range_join(points, ranges, "v", "lo", "hi").collect())
    assert got == Counter([(i, 1) for i in range(-2, 6)] + [(i, 2) for i in range(-5, 1)] + [(i, 4) for i in range(-5, 0)])
    cents = points.select((F.col("v") % 7).cast("decimal(10,2)").alias("v"))
    few = spark.createDataFrame([(1, 2, 5)], "band int, lo long, hi long")
    assert range_join(cents, few, "v", "lo", "hi").count() == cents.where("v >= 2 and v < 5").count()
    assert range_join(points.limit(0), ranges, "v", "lo", "hi").count() == 0


def test_pairs_of_overlapping_ranges_take_few_bytes(spark, tmp_path):
    """Pairs grow with the square of the rows: what is written must not hold each of them on its own."""
    mixed = lambda seed: F.xxhash64(F.col("id"), F.lit(seed))
    points = spark.range(40_000).select(mixed(1).alias("key"), (F.pmod(mixed(2), F.lit(100_000)) / 100).alias("v"))
    ranges = spark.range(600).select(mixed(3).alias("band"), (F.pmod(mixed(4), F.lit(80_000)) / 100).alias("lo"))
    pairs = range_join(points, ranges.withColumn("hi", F.col("lo") + 200), "v", "lo", "hi").select("key", "band")
    pairs.write.parquet(f"file:{tmp_path}/pairs")
    count = spark.read.parquet(f"file:{tmp_path}/pairs").count()
    assert count > 4_000_000
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 0.5 * count


def test_points_of_one_value_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(inequality, "DEALT", 100)
    points = spark.range(1000).select("id", F.lit(5.0).alias("v"))
    ranges = spark.range(80).select("id", F.lit(0.0).alias("lo"), F.lit(9.0).alias("hi")).withColumnRenamed("id", "band")
    tasks = range_join(points, ranges, "v", "lo", "hi").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 80_000 and len(tasks) == 10 and max(r["count"] for r in tasks) < 20_000
