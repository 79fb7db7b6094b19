"""Queries against SQL, and the pipeline against its stages."""

import compare
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from rillflow.llm import CATALOG
from rillflow.llm.common import BitFilter, written

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql])
def test_agrees_with_sql(spark, monkeypatch, name):
    monkeypatch.setitem(compare.CATALOG, name, CATALOG[name])
    assert compare.difference(spark, compare.connect(SMALL), name, SMALL) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.EXTRA) == {*CATALOG, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in CATALOG) == list(range(1, 14))


def test_bit_filter(spark):
    import numpy as np

    hashes = [0, 5, -1, -(1 << 63), 12345678901234567, 12345678901234567]
    known = BitFilter(spark, spark.createDataFrame([(h,) for h in hashes], "h long"))
    assert known(np.array(hashes, dtype=np.int64).view(np.uint64)).all()
    assert not known(np.arange(6, 1000, dtype=np.uint64)).any()
    assert not BitFilter(spark, spark.createDataFrame([], "h long"))(np.arange(9, dtype=np.uint64)).any()


def test_stages(spark):
    """A document for every decision, beside clean ones that have to come through."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    clean = docs.orderBy("doc_id").collect()
    long = next(r for r in clean if r.lang == "en" and 150 < len(r.text.split()) < 400)
    other = next(r for r in reversed(clean) if len(r.text.split()) > 150)
    passage = " ".join(other.text.split()[40:110])
    more = [(1000, "12 34 ?!", "en"), (1001, None, "en"), (1002, long.text, "en"), (1003, long.text.upper(), "en"),
            (1004, "Unlike words before. " + passage + " Others stand behind it.", "en"),
            (1005, "Words of its own, many of them, and then: " + item + " So it ends.", "en")]
    whole = docs.withColumn("extra", F.lit("z")).unionByName(spark.createDataFrame(
        [(i, t, lang, "s", len(t or ""), "z") for i, t, lang in more],
        "doc_id long, text string, lang string, source string, n_chars long, extra string"))
    at, seen = whole, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = written(stage(spark, at, SMALL), name)
        if name != "packing":
            assert at.dtypes == before.dtypes
        seen[name] = {r.doc_id: r for r in at.collect()}
    ids = lambda name: set(seen[name])
    assert ids("language") == {r.doc_id for r in whole.collect()} - {1000, 1001}
    assert not ids("near_duplicates") & {1002, 1003} and {long.doc_id, other.doc_id, 1004, 1005} <= ids("near_duplicates")
    assert ids("repeats") == ids("near_duplicates")
    assert seen["repeats"][1004].text == "Unlike words before. Others stand behind it."
    assert seen["repeats"][1004].n_chars == 44
    assert 1005 not in ids("benchmark") and 1004 in ids("benchmark")
    assert ids("packing") == ids("benchmark")
    assert {r.extra for r in seen["benchmark"].values()} == {"z"}


def test_run_is_the_stages_in_turn(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "packing"]
    rows = corpus_pipeline.run(spark, SMALL)
    total = rows.agg(F.sum("length"), F.max(F.col("sequence_id") * 2048 + F.col("offset") + F.col("length"))).first()
    assert total[0] == total[1] > 0
