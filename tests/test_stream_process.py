"""Keyed processes, set operations over whole streams and late rows, in several orders and over restarts."""

import datetime as dt
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from rillflow.plans.catalog.streams import _NoPurchase
from rillflow.session import is_directory
from rillflow.streaming import KeyedProcess, LateSplit, ParquetSink, Variable, drain, event_time, keyed_process, set_changes, start

BEGIN = dt.datetime(2024, 5, 1)
EVENTS = "event_id long, user_id long, event_type string, ts timestamp"


def at(minutes):
    return BEGIN + dt.timedelta(minutes=minutes, microseconds=3)


def fed(spark, folder, parts, query, sink=None):
    feed, sink = f"{folder}/feed", sink or ParquetSink(f"{folder}/sink")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(feed)
        drain(query(spark.readStream.schema(part.schema).parquet(feed)), sink, f"{folder}/state")
    return sink.read(spark)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_timers_and_variables(spark, folder, order):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 2, None]), rng.choice(["click", "purchase"]), rng.randrange(300)) for i in range(60)]
    thirds = [[r for r in rows if lo <= r[3] < lo + 100] for lo in (0, 100, 200)]
    # parts come up to 200 minutes late; in order of time the clock stops in between, with clicks waiting on either side
    delay = "250 minutes" if order[0] else "5 minutes"
    parts = [thirds[i] for i in order] + [[(900, 7, "click", 2000)]]
    frames = [spark.createDataFrame([(i, u, e, at(t)) for i, u, e, t in p], EVENTS) for p in parts]

    def query(stream):
        rows = event_time(stream, "ts", delay).drop("ts")
        return keyed_process(rows, ["user_id"], _NoPurchase(), "user_id long, event_id long", at="rowtime")

    got = sorted((r.event_id, r.user_id) for r in fed(spark, folder, frames, query).collect())
    bought = [(u, t) for _, u, e, t in rows if e == "purchase"]
    assert got == sorted((i, u) for i, u, e, t in rows if e == "click"
                         and not any(v == u and t <= b <= t + 30 for v, b in bought))


def sessions():
    # inside a function, as workers can't import this file
    class Sessions(KeyedProcess):
        """Uses every kind of variable; a value that fades away counts rows of a second at most."""

        variables = {"recent": Variable("value", ttl_ms=1000), "all": Variable("value"), "seen": Variable("map"), "order": Variable("list")}

        def on_rows(self, key, rows, state):
            for row in rows:
                state["recent"].put(state["recent"].get(0) + 1)
                state["all"].put(state["all"].get(0) + 1)
                state["seen"].put(row["event_type"], state["seen"].get(row["event_type"], 0) + 1)
                state["order"].append(row["event_id"])
            state.wake(state.now + 1)
            yield {"k": key["user_id"], "recent": state["recent"].get(0), "n": state["all"].get(), "seen": dict(state["seen"].items()),
                   "ids": list(state["order"]), "timer": False}
            state["seen"].remove("click")

        def on_timer(self, key, at, state):
            yield {"k": key["user_id"], "timer": True, "n": state["all"].get(0)}

    return Sessions()


def test_time_to_live_and_processing_time(spark, folder):
    returns = "k long, recent int, n int, seen map<string, int>, ids array<long>, timer boolean"
    query = lambda s: keyed_process(s, ["user_id"], sessions(), returns, time="processing")
    feed, sink, rows = f"{folder}/feed", ParquetSink(f"{folder}/sink"), []
    spark.createDataFrame([], EVENTS).write.parquet(feed)
    # such a query looks for timers that are due again and again, so it is stopped by hand
    running = start(query(spark.readStream.schema(EVENTS).parquet(feed)), sink, f"{folder}/state", every="1 second")
    try:
        for n, part in enumerate(([(1, 5, "click"), (2, 5, "view")], [(3, 5, "view")]), 1):
            spark.createDataFrame([(i, u, e, at(0)) for i, u, e in part], EVENTS).coalesce(1).write.mode("append").parquet(feed)
            for _ in range(40):
                time.sleep(1.2)
                rows = sink.read(spark).collect() if running.lastProgress and is_directory(spark, sink.path) else []
                if sum(not r.timer for r in rows) == n and any(r.timer for r in rows):
                    break
            time.sleep(1.2)
    finally:
        running.stop()
    first, last = sorted((r for r in rows if not r.timer), key=lambda r: r.n)
    assert (first.recent, first.n, first.seen, first.ids) == (2, 2, {"click": 1, "view": 1}, [1, 2])
    assert (last.recent, last.n, last.seen, last.ids) == (1, 3, {"view": 2}, [1, 2, 3])
    assert any(r.timer for r in rows)


def test_what_a_process_may_ask_for(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="time to live"):
        keyed_process(stream, ["value"], sessions(), "k long", time="none")
    with pytest.raises(ValueError, match="event"):
        keyed_process(stream, ["value"], KeyedProcess(), "k long", time="event")


SETS = "side string, k string, n int, sign int"


@pytest.mark.parametrize(("kind", "signed"), [("except", True), ("except all", True), ("intersect", False), ("intersect all", True)])
def test_set_operations_over_whole_streams(spark, folder, kind, signed):
    rng = random.Random(6)
    rows = [(rng.choice("lr"), rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), rng.choice([1, 1, 1, -1] if signed else [1]))
            for _ in range(120)]
    parts = [spark.createDataFrame(rows[at::3], SETS) for at in (2, 0, 1)]

    def query(stream):
        left, right = (stream.filter(F.col("side") == s).select("k", "n", *(["sign"] if signed else [])) for s in "lr")
        return set_changes(left, right, kind, "sign" if signed else None)

    net = fed(spark, folder, parts, query).groupBy("k", "n").agg(F.sum("sign").alias("times")).where("times <> 0").collect()
    counts = {s: Counter() for s in "lr"}
    for side, k, n, sign in rows:
        counts[side][k, n] += sign
    left, right = +counts["l"], +counts["r"]
    want = {"except": Counter(set(left) - set(right)), "except all": left - right, "intersect": Counter(set(left) & set(right)),
            "intersect all": left & right}[kind]
    assert {(r.k, r.n): r.times for r in net} == dict(want)
    with pytest.raises(ValueError, match="set operation"):
        set_changes(spark.createDataFrame(rows, SETS), spark.createDataFrame(rows, SETS), "union")


def test_late_rows_go_to_the_side(spark, folder):
    parts = [[(1, 0, "a", 0), (2, 0, "a", 100)], [(3, 0, "a", 79), (4, 0, "a", 81), (5, 0, "a", None)], [],
             [(6, 0, "a", 300)], [(7, 0, "a", 150), (8, 0, "a", 281)]]
    frames = [spark.createDataFrame([(i, u, e, None if t is None else at(t)) for i, u, e, t in p], EVENTS) for p in parts]
    split = LateSplit("ts", "20 minutes", ParquetSink(f"{folder}/kept"), ParquetSink(f"{folder}/late"), f"{folder}/marks")
    got = {r.event_id: r.late for r in fed(spark, folder, frames, lambda s: s, split).collect()}
    # watermarks: none, 80, 80, 280; the side has what lies at or behind them
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False}


def test_a_repeated_batch_is_split_as_before(spark, folder):
    split = LateSplit("ts", "20 minutes", ParquetSink(f"{folder}/kept"), ParquetSink(f"{folder}/late"), f"{folder}/marks")
    rows = lambda *times: spark.createDataFrame([(t, 0, "a", at(t)) for t in times], EVENTS)
    split.write(rows(10, 100), 0)
    split.write(rows(50, 200), 1)
    split.write(rows(50, 200), 1)                                       # the driver was lost before the commit
    split.write(rows(150, 190), 2)
    split.write(rows(10, 100), 0)                                       # and once more from the start
    assert sorted((r.event_id, r.late) for r in split.read(spark).collect()) == [
        (10, False), (50, True), (100, False), (150, True), (190, False), (200, False)]
