"""Table functions that take rows one by one."""

import pytest
from rillflow.plans.catalog import CATALOG


def test_rows_are_spread_and_not_sent_one_by_one(spark, folder):
    rows = [(i, f"a{i} b c{i}"[: i % 9]) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    got = CATALOG["udtf_custom"].run(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # before: an Arrow batch for each row, in as many tasks as the file has splits
    assert "ArrowEvalPythonUDTF" not in plan and "RoundRobinPartitioning" in plan
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, at, w) for k, name in rows for at, w in enumerate(name.split(" ")))


@pytest.mark.parametrize("text", ["", " ", "a  b"])
def test_empty_pieces(spark, folder, text):
    spark.createDataFrame([(1, text)], "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    assert [r.piece for r in CATALOG["udtf_custom"].run(spark, folder).orderBy("at").collect()] == text.split(" ")
