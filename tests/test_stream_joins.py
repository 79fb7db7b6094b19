"""Joins and rankings of streams: parts in several orders with a restart between them, against plain Python."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rillflow.operators import interval_join
from rillflow.streaming import (
    ParquetSink, asof_stream, event_time, join_changes, merged_ranking, start, topk_changes,
)
from rillflow.streaming.payload import packed, unpacked

BEGIN = dt.datetime(2024, 5, 1)
ORDERS = [(0, 1, 2), (2, 0, 1), (1, 2, 0)]


def at(minutes):
    return None if minutes is None else BEGIN + dt.timedelta(minutes=minutes, microseconds=7)


def fed(spark, folder, parts, query):
    """Feeds the parts one after the other, a new query from the same checkpoint for each; rows of the state after each."""
    feed, sink, rows = f"{folder}/feed", ParquetSink(f"{folder}/sink"), []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(feed)
        running = start(query(spark.readStream.schema(part.schema).parquet(feed)), sink, f"{folder}/state")
        running.awaitTermination()
        rows.append(sum(o["numRowsTotal"] for o in running.lastProgress["stateOperators"]))
    return sink.read(spark), rows


SIDES = "side string, k int, t timestamp, id long, body string"


def two_sides(spark, rows):
    return spark.createDataFrame([(s, k, at(t), i, b) for s, k, t, i, b in rows], SIDES)


def sides(stream, delay):
    """The two streams with their own watermarks."""
    left = event_time(stream.filter("side = 'l'"), "t", delay, "lt").select("k", "lt", F.col("id").alias("l_id"), "body")
    right = event_time(stream.filter("side = 'r'"), "t", delay, "rt").select(
        "k", "rt", F.col("id").alias("r_id"), F.col("body").alias("r_body"))
    return left, right


def sample(n=150):
    rng = random.Random(11)
    rows = [("l" if rng.random() < 0.5 else "r", rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(200), i, rng.choice(["x", None]))
            for i in range(n)]
    # far ahead of all others, to move both watermarks beyond them
    close = [("l", 9, 1000, 1000, "end"), ("r", 9, 1000, 1001, "end")]
    return rows, close


def three(rows):
    return [rows[0::3], rows[1::3], rows[2::3]]


def best(rows, k, t, within=None):
    """Id of the latest right row of the key at or before t, the greatest id among equals."""
    found = [(rt, i) for s, rk, rt, i, _ in rows if s == "r" and rk == k and k is not None and rt <= t]
    found = [x for x in found if within is None or t - x[0] <= within]
    return max(found)[1] if found else None


@pytest.mark.parametrize(("order", "ways", "within"), [(ORDERS[1], 1, None), (ORDERS[2], 3, 20)])
def test_asof_in_any_order(spark, folder, order, ways, within):
    rows, close = sample()

    def query(stream):
        left, right = sides(stream, "400 minutes")
        return asof_stream(left, right, ["k"], "lt", "rt", {"r_id": "found", "r_body": "found_body"}, tie="r_id",
                           slot="30 minutes", within=f"{within} minutes" if within else None, ways=ways)

    parts = [two_sides(spark, three(rows)[i]) for i in order] + [two_sides(spark, close)]
    out, held = fed(spark, folder, parts, query)
    got = sorted(((r.l_id, r.k, r.body, r.found) for r in out.collect()), key=str)
    assert got == sorted(((i, k, b, best(rows, k, t, within)) for s, k, t, i, b in rows if s == "l"), key=str)
    bodies = {i: b for *_, i, b in rows}
    assert all(r.found_body == bodies.get(r.found) and r.lt.microsecond == 7 for r in out.collect())
    assert out.columns == ["k", "lt", "l_id", "body", "found", "found_body"]
    # what lies before the watermark shrinks to a row per key, or to nothing where it is out of reach
    assert held[2] > 40 and held[-1] < held[2] / 2


def test_asof_rows_held_back_and_late_ones_dropped(spark, folder):
    def query(stream):
        left, right = sides(stream, "10 minutes")
        return asof_stream(left, right, ["k"], "lt", "rt", {"r_id": "found"}, slot="7 minutes")

    parts = [[("r", 1, 0, 10, ""), ("l", 1, 50, 1, ""), ("r", 1, 60, 11, ""), ("l", 1, 60, 2, "")],
             [("r", 1, 49, 12, ""), ("l", 1, 51, 3, "")],                # late: the watermark stands at 50
             [("l", 1, 55, 4, ""), ("r", 1, 54, 13, "")],
             [("l", 1, 200, 5, ""), ("r", 1, 200, 14, "")],
             [("l", 1, None, 6, ""), ("r", 1, None, 15, "")]]
    out, _ = fed(spark, folder, [two_sides(spark, p) for p in parts], query)
    # 50 is due at the first watermark, 51 finds nothing newer than 0 as 49 came late, 55 finds 54, 200 is still held
    assert sorted((r.l_id, r.found) for r in out.collect()) == [(1, 10), (2, 11), (3, 10), (4, 13)]


def test_asof_holds_many_keys_in_one_group(spark, folder):
    n = 3000
    rows = [("r", k, k % 50, k, "") for k in range(n)] + [("l", k, 60 + k % 50, n + k, "") for k in range(n)]
    rows += [("r", k, 70, 2 * n + k, "") for k in range(0, n, 7)]

    def query(stream):
        left, right = sides(stream, "400 minutes")
        return asof_stream(left, right, ["k"], "lt", "rt", {"r_id": "found"}, slot="1 day")

    close = [("l", n, 2000, -1, "end"), ("r", n, 2000, -2, "end")]
    again = [("l", k, 1700, 3 * n + k, "") for k in range(n)]           # find what is kept of a slot that has passed
    last = [("l", n, 9000, -3, "end"), ("r", n, 9000, -4, "end")]
    out, held = fed(spark, folder, [two_sides(spark, part) for part in (rows, close, again, last)], query)
    key, rights = {r[3]: r[1] for r in rows + again}, {}
    for _, k, t, i, _ in (r for r in rows if r[0] == "r"):
        rights.setdefault(k, []).append((t, i))
    want = {i: max(x for x in rights[k] if x[0] <= t)[1] for s, k, t, i, _ in rows + again if s == "l"}
    got = {r.l_id: r.found for r in out.collect() if r.k < n}
    assert got == want and all(key[i] == key[f] for i, f in got.items())
    assert max(held) < n                                            # before: rows of the state for each key


@pytest.mark.parametrize(("order", "how"), [(ORDERS[0], "left"), (ORDERS[1], "full"), (ORDERS[2], "right")])
def test_outer_interval_joins(spark, folder, order, how):
    rows, close = sample()

    def query(stream):
        left, right = sides(stream, "400 minutes")
        return interval_join(left, right, ["k"], "lt", "rt", 15 * 60_000, 9 * 60_000, how=how)

    parts = [two_sides(spark, three(rows)[i]) for i in order] + [two_sides(spark, close)]
    out, held = fed(spark, folder, parts, query)
    ls, rs = ([(k, t, i) for s, k, t, i, _ in rows if s == side] for side in "lr")
    pairs = [(k, i, j) for k, t, i in ls for rk, rt, j in rs if k == rk and k is not None and 0 <= rt - t <= 15]
    alone = []
    if how in ("left", "full"):
        alone += [(k, i, None) for k, _, i in ls if i not in {p[1] for p in pairs}]
    if how in ("right", "full"):
        alone += [(k, None, j) for k, _, j in rs if j not in {p[2] for p in pairs}]
    end = [(9, 1000, 1001)]
    assert Counter((r.k, r.l_id, r.r_id) for r in out.collect()) == Counter(pairs + alone + end)
    assert held[-1] < held[2] / 4


def test_outer_interval_joins_of_tables(spark):
    rows, _ = sample(400)
    rows += rows[:40]                                                    # repeated rows stay as many
    left, right = sides(two_sides(spark, rows), "1 minute")
    ls, rs = ([(k, t, i) for s, k, t, i, _ in rows if s == side] for side in "lr")
    hit = lambda a, b: a[0] == b[0] and a[0] is not None and 0 <= b[1] - a[1] <= 15
    want = Counter((a[0], a[2], b[2]) for a in ls for b in rs if hit(a, b))
    want += Counter((a[0], a[2], None) for a in ls if not any(hit(a, b) for b in rs))
    want += Counter((b[0], None, b[2]) for b in rs if not any(hit(a, b) for a in ls))
    got = interval_join(left, right, ["k"], "lt", "rt", 15 * 60_000, how="full")
    assert Counter((r.k, r.l_id, r.r_id) for r in got.collect()) == want
    with pytest.raises(ValueError, match="left"):
        interval_join(left, right, ["k"], "lt", "rt", 1, how="cross")


CHANGES = "side string, k int, a long, price decimal(9,2), when timestamp_ntz, sign int"


def changes():
    """Rows that come, some twice, some that go again, some before they have come."""
    rng, rows = random.Random(5), []
    for i in range(90):
        row = (rng.choice("lr"), rng.choice([1, 1, 2, 3, None]), i % 40, Decimal(i % 7) / 4, BEGIN + dt.timedelta(microseconds=i % 5))
        rows += [(*row, 1)] * rng.choice([1, 1, 2]) + [(*row, -1)] * rng.choice([0, 0, 1])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("order", "ways"), [(ORDERS[1], 4), (ORDERS[2], 1)])
def test_join_of_changes_is_the_join_of_what_is_left(spark, folder, order, ways):
    rows = changes()

    def query(stream):
        left = stream.filter("side = 'l'").drop("side")
        right = stream.filter("side = 'r'").select("k", F.col("a").alias("b"), F.col("price").alias("r_price"), "sign")
        return join_changes(left, right, ["k"], ways=ways)

    out, _ = fed(spark, folder, [spark.createDataFrame(three(rows)[i], CHANGES) for i in order], query)
    assert out.columns == ["k", "a", "price", "when", "b", "r_price", "sign"]
    net = out.groupBy(*out.columns[:-1]).agg(F.sum("sign").alias("n")).where("n <> 0").collect()
    left, right = Counter(), Counter()
    for side, k, a, price, when, sign in rows:
        if k is not None:
            (left if side == "l" else right)[(k, a, price, when) if side == "l" else (k, a, price)] += sign
    want = {(*x, *y[1:]): n * m for x, n in left.items() for y, m in right.items() if x[0] == y[0] and n * m}
    assert {tuple(r)[:-1]: r.n for r in net} == want


def ranking(rows, count, descending):
    left = Counter()
    for k, value, tie, sign in rows:
        if value is not None:
            left[k, value, tie] += sign
    out = {}
    for k in {x[0] for x in left}:
        own = sorted((-v if descending else v, tie is not None, tie or 0) for (g, v, tie), n in left.items() if g == k for _ in range(n))
        for rank, (v, has, tie) in enumerate(own[:count]):
            out[k, rank + 1] = (-v if descending else v, tie if has else None)
    return out


TOP = "k string, v long, tie long, sign int"


@pytest.mark.parametrize("order", [(2, 1, 0), (0, 2, 1)])
def test_top_rows_with_deletes(spark, folder, order):
    rng, rows = random.Random(9), []
    for i in range(120):
        row = (rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-30, 30)]), rng.choice([None, *range(5)]))
        rows += [(*row, 1)] * rng.choice([1, 1, 2]) + [(*row, -1)] * rng.choice([0, 1])
    rng.shuffle(rows)
    descending = order[0] < 2
    query = lambda s: topk_changes(s, ["k"], "v", 4, "tie", sign="sign", descending=descending, width=8)
    log, _ = fed(spark, folder, [spark.createDataFrame(three(rows)[i], TOP) for i in order], query)
    net = log.groupBy("k", "v", "tie", "rank").agg(F.sum("sign").alias("n")).where("n <> 0").collect()
    assert all(r.n == 1 for r in net)
    assert {(r.k, r["rank"]): (r.v, r.tie) for r in net} == ranking(rows, 4, descending)


@pytest.mark.parametrize("ways", [1, 5])
def test_top_rows_that_only_come(spark, folder, ways):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(10 ** 6), i, 1) for i in range(1200)]
    query = lambda s: topk_changes(s.drop("sign"), ["k"], "v", 6, "tie", width=50_000, ways=ways)
    log, held = fed(spark, folder, [spark.createDataFrame(p, TOP) for p in three(rows)], query)
    net = merged_ranking(log, ["k"], "v", 6, "tie")
    assert {(r.k, r["rank"]): (r.v, r.tie) for r in net.collect()} == ranking(rows, 6, True)
    # blocks, index and ranking of each key and part, never the rows behind them
    assert max(held) <= 2 * ways * (6 + 2)


def test_top_rows_need_to_know_of_deletes(spark, folder):
    part = spark.createDataFrame([("a", 1, 1, -1)], TOP)
    with pytest.raises(Exception, match="deletes"):
        fed(spark, folder, [part], lambda s: _raw_top(s))


def _raw_top(stream):
    from rillflow.streaming import changes as module

    rows = stream.select(F.lit("a").alias("who"), F.lit(0).alias("part"), F.col("v").alias("at"), "tie", F.lit("{}").alias("body"),
                         F.col("sign").cast("long").alias("sign"))
    return rows.groupBy("who", "part").transformWithStateInPandas(
        module._TopChanges(2, 4, False), "part int, rank int, body string, sign int", "append", "none")


def test_rows_as_texts_keep_their_values(spark):
    schema = ("i int, l long, d double, f float, n decimal(20,7), s string, b boolean, y binary, e date, t timestamp, "
              "z timestamp_ntz, a array<struct<x: long, y: string>>, m map<string, double>, st struct<p: long, q: array<int>>")
    when = dt.datetime(2024, 2, 29, 23, 59, 59, 123457)
    rows = [(1, 1 << 62, 0.1 + 0.2, 0.5, Decimal("1234567890123.1234567"), 'a"b\\\n é𝕏', True, b"\x00\xff", when.date(), when, when,
             [(1, None), None], {"k": 1.5, "": None}, (None, [1, None])), (None,) * 14,
            (0, 0, float("inf"), float("-inf"), Decimal(0), "", False, b"", dt.date(1, 1, 1), when, when, [], {}, (1, []))]
    df = spark.createDataFrame(rows, schema)
    back = df.select(packed(df.columns).alias("text")).select(unpacked("text", df.schema.fields).alias("r")).select("r.*")
    assert back.collect() == df.collect()
    assert [f.dataType for f in back.schema] == [f.dataType for f in T.StructType(df.schema.fields)]
