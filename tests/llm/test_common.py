"""Batches for Python workers are bounded by their bytes, not only by their rows."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rillflow.llm import common


def sizes(docs):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    return [r["bytes"] for r in docs.mapInArrow(run, "bytes long").collect()]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_the_pipeline_get_small_batches(spark, tmp_path, stage):
    spark.createDataFrame([(1, "b " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, f"one two three {i}", "en", "x", 9) for i in range(6)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    before = spark.conf.get(common.BYTES)
    try:
        spark.conf.set(common.BYTES, 64 << 20)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
        long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("a long text "), 5000).alias("text"))
        found = sizes(long)
        assert sum(found) >= 400 * 60_000 and max(found) < common.BATCH_BYTES + 200_000
    finally:
        spark.conf.set(common.BYTES, before.rstrip("b"))


def test_a_smaller_bound_stays(spark):
    before = spark.conf.get(common.BYTES)
    try:
        spark.conf.set(common.BYTES, 1 << 20)
        common.small_batches(spark)
        assert int(spark.conf.get(common.BYTES).rstrip("b")) == 1 << 20
    finally:
        spark.conf.set(common.BYTES, before.rstrip("b"))


def test_a_batch_of_long_texts_holds_about_a_megabyte(spark):
    before = spark.conf.get(common.BYTES)
    try:
        spark.conf.set(common.BYTES, 64 << 20)
        common.small_batches(spark)
        found = sizes(spark.range(100, numPartitions=1).select(F.repeat(F.lit("a long text "), 5000).alias("text")))
        assert sum(found) >= 100 * 60_000 and max(found) < 1_300_000
    finally:
        spark.conf.set(common.BYTES, before.rstrip("b"))
