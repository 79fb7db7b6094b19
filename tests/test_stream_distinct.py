"""Distinct counts on streams whose parts come in another order, with restarts, against sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from rillflow.streaming import ChangelogSink, ParquetSink, distinct_counts, distinct_sketches, drain, event_time, united

BEGIN = dt.datetime(2024, 5, 1)
ROWS = "k string, v long, t timestamp"


def sample():
    rng = random.Random(1)
    # one key and one value hold most rows
    return [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([7, 7, 7, None, rng.randrange(40)]), rng.randrange(360))
            for _ in range(500)]


def fed(spark, folder, parts, query, sink):
    for part in parts:
        rows = spark.createDataFrame([(k, v, BEGIN + dt.timedelta(minutes=m)) for k, v, m in part], ROWS)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        drain(query(spark.readStream.schema(ROWS).parquet(f"{folder}/feed")), sink, f"{folder}/state")
    return sink.read(spark)


def starts(df):
    return df.withColumn("at", (F.unix_seconds("window_start") - int(BEGIN.replace(tzinfo=dt.timezone.utc).timestamp())) / 60)


def test_exact_counts(spark, folder):
    rows = sample()
    query = lambda s: distinct_counts(event_time(s, "t", "500 minutes"), ["k"], "v", "rowtime", "1 hour").select(
        "k", F.col("window.start").alias("window_start"), "n")
    parts = [rows[1::3], rows[0::3], rows[2::3], [("end", 1, 5000)]]
    got = {(r.k, r["at"]): r.n for r in starts(fed(spark, folder, parts, query, ParquetSink(f"{folder}/sink"))).collect()}
    want = {}
    for k, v, m in rows:
        if v is not None:
            want.setdefault((k, m // 60 * 60), set()).add(v)
    assert got == {w: len(found) for w, found in want.items()}


def test_sketches_unite_to_sliding_windows(spark, folder):
    rows = sample()
    query = lambda s: distinct_sketches(event_time(s, "t", "500 minutes"), ["k"], "v", "rowtime", "1 hour").select(
        "k", F.col("window.start").alias("window_start"), "sketch")
    sink = ChangelogSink(f"{folder}/panes", ["k", "window_start"])
    panes = fed(spark, folder, [rows[1::2], rows[0::2]], query, sink)
    got = {(r.k, r["at"]): r.n for r in starts(united(panes, ["k"], "1 hour", "3 hours")).collect()}
    want = {}
    for k, v, m in rows:
        if v is not None:
            for back in range(3):
                want.setdefault((k, (m // 60 - back) * 60), set()).add(v)
    assert set(got) == set(want) and all(abs(got[w] - len(found)) <= max(1, 0.05 * len(found)) for w, found in want.items())
    with pytest.raises(ValueError, match="panes"):
        united(panes, ["k"], "1 hour", "90 minutes")
