"""Streams cut into several micro-batches, over tables stored as folders of part files."""

import os
import shutil
from functools import partial
from pathlib import Path

import compare
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from rillflow.plans.catalog import CATALOG, composition, sinking, sourcing, streams
from rillflow.session import scratch, shared_root
from rillflow.sources import replay
from rillflow.streaming import ChangelogSink, ParquetSink, dedup, drain, event_time, micro_batch_sql, start, tumble

SMALL = "/root/testdata/sf0.001"
PARTS = 5
# Append results depend on how far the watermark gets, which these do not leave open.
IN_PARTS = [
    "src_replay", "win_tumble", "win_tumble_label", "win_hop", "stream_watermark", "stream_session",
    "stream_running_count", "stream_topk", "stream_keyed_state", "stream_proc_window", "stream_idempotent_batch",
    "stream_interval_join", "join_stream_static", "sink_fanout", "sink_foreach", "sink_contract", "q_view_watermark",
    "q_microbatch_sql", "q_insert_select", "q_insert_columns", "stream_early_fire",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The small tables; events and orders as folders of time-ordered parts, oldest first."""
    root = tmp_path_factory.mktemp("tables")
    for file in Path(SMALL).glob("*.parquet"):
        order = {"events": "ts", "orders": "o_orderdate"}.get(file.stem)
        if not order:
            shutil.copy(file, root / file.name)
            continue
        rows = pq.read_table(file).sort_by(order)
        (root / file.name).mkdir()
        step = -(-len(rows) // PARTS)
        for at in range(PARTS):
            part = root / file.name / f"part-{at}.parquet"
            pq.write_table(rows.slice(at * step, step), part)
            os.utime(part, (1_700_000_000 + at, 1_700_000_000 + at))
    return str(root)


@pytest.mark.parametrize("name", IN_PARTS)
def test_many_batches_give_the_same_result(spark, tables, monkeypatch, name):
    for module in (streams, composition, sinking, sourcing):
        monkeypatch.setattr(module, "replay", partial(replay, max_bytes=1))
    assert compare.difference(spark, compare.connect(SMALL), name, tables) is None


def test_parts_are_separate_batches(spark, tables):
    sink = ParquetSink(scratch(spark, "parts"))
    drain(replay(spark, tables, "events", max_bytes=1), sink, scratch(spark, "parts-state"))
    assert sink.rows(spark).select("batch_id").distinct().count() == PARTS


@pytest.mark.parametrize("name", ["decode_quarantine", "join_asof", "win_session", "win_rank", "topk_per_group"])
def test_batch_queries_read_folders(spark, tables, name):
    assert compare.difference(spark, compare.connect(SMALL), name, tables) is None


def test_restart_goes_on_where_it_stopped(spark, folder):
    state, sink = scratch(spark, "restart"), ChangelogSink(folder + "-out", ["k"])

    def run():
        stream = spark.readStream.schema("k long").parquet(folder)
        drain(stream.groupBy("k").agg(F.count("*").alias("n")), sink, state)

    spark.range(3).toDF("k").write.parquet(folder)
    run()
    spark.range(1, 4).toDF("k").write.mode("append").parquet(folder)
    run()
    run()
    assert sorted(map(tuple, sink.read(spark).collect())) == [(0, 1), (1, 2), (2, 2), (3, 1)]


def test_rows_of_closed_windows_are_dropped(spark, folder):
    state, sink = scratch(spark, "late"), ChangelogSink(folder + "-out", ["s"])

    def run(*millis):
        spark.createDataFrame([(m,) for m in millis], "ms long").coalesce(1).write.mode("append").parquet(folder)
        stream = event_time(spark.readStream.schema("ms long").parquet(folder), "ms", "10 seconds")
        counts = stream.groupBy(tumble("rowtime", "10 seconds")).agg(F.count("*").alias("n"))
        drain(counts.select(F.unix_seconds("window.start").alias("s"), "n"), sink, state)

    run(1_000, 12_000)
    run(31_000)
    run(2_000, 13_000, 22_000)
    # The watermark is 21 s: the windows from 0 s and 10 s are closed, the one from 20 s is open.
    assert sorted(map(tuple, sink.read(spark).collect())) == [(0, 1), (10, 1), (20, 1), (30, 1)]


def test_dedup_across_batches(spark, folder):
    state, sink = scratch(spark, "dedup"), ParquetSink(folder + "-out")
    for batch in ([(1, 1_000), (1, 1_000), (2, 1_500)], [(1, 2_000), (3, 2_500)], [(4, 900_000)], [(1, 901_000)]):
        spark.createDataFrame(batch, "id int, ms long").repartition(2).write.mode("append").parquet(folder)
        stream = event_time(spark.readStream.schema("id int, ms long").parquet(folder), "ms", "1 minute")
        drain(dedup(stream, ["id"], ways=3).select("id"), sink, state)
    # Key 1 comes back once the watermark has left its first row behind.
    assert sorted(r.id for r in sink.read(spark).collect()) == [1, 1, 2, 3, 4]


def test_micro_batch_statements_run_in_order(spark, folder):
    spark.range(6).write.parquet(folder)
    first, second = ParquetSink(folder + "-1"), ParquetSink(folder + "-2")
    shared = micro_batch_sql("numbers", [
        ("SELECT id, row_number() OVER (ORDER BY id DESC) AS rn FROM numbers", first),
        ("SELECT id FROM numbers EXCEPT SELECT id FROM numbers WHERE id > 2", second),
    ])
    drain(spark.readStream.schema("id long").parquet(folder), shared, scratch(spark, "micro"))
    assert first.read(spark).filter("rn = 1").first().id == 5
    assert second.read(spark).count() == 3


def test_named_query_with_trigger(spark, folder):
    spark.range(3).write.parquet(folder)
    sink = ParquetSink(folder + "-out")
    query = start(spark.readStream.schema("id long").parquet(folder), sink, scratch(spark, "named"), every="1 second",
                  name="named_query")
    query.processAllAvailable()
    assert query.name == "named_query"
    query.stop()
    assert sink.read(spark).count() == 3


def test_state_lives_in_the_configured_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(shared_root(spark))


def test_streams_all_have_sql():
    assert all(CATALOG[name].sql for name in IN_PARTS)


def test_state_of_quiet_keys_goes(spark, tmp_path):
    from pyspark.sql import functions as F
    from rillflow.functions import Accumulator
    from rillflow.streaming import ChangelogSink, drain, event_time, running_state

    class Count(Accumulator):
        state, result = "n bigint", "bigint"

        def zero(self):
            return (0,)

        def add(self, state, values):
            return (state[0] + len(values),)

    feed = f"file:{tmp_path}/feed"
    sink = ChangelogSink(f"file:{tmp_path}/out", ["k", "part"])
    for k, at in (("a", 0), ("b", 1), ("b", 100), ("b", 101), ("b", 102), ("a", 103)):
        spark.createDataFrame([(k, at)], "k string, at long").select(
            "k", F.timestamp_seconds("at").alias("ts")).write.mode("append").parquet(feed)
        rows = event_time(spark.readStream.schema("k string, ts timestamp").parquet(feed), "ts", "1 second")
        drain(running_state(rows, ["k"], "k", Count(), ["ts"], ttl_ms=20_000), sink, f"file:{tmp_path}/state")
    assert {r.k: r.n for r in sink.read(spark).collect()} == {"a": 1, "b": 2}
