import pytest
from collections.abc import Callable
from rillflow.options import REQUIRED, Option, listed, read_options
from rillflow.plans.pipeline import Pipeline
from rillflow.schema import TableDef
from rillflow.streaming import ParquetSink, named_sink, sink_connector

DECLARED = [Option("name", str, "nobody", "what to call it"), Option("age", int, description="in years"),
            Option("loud", bool, False)]


def test_defaults_types_and_errors():
    assert read_options("x", DECLARED, {"age": "7"}) == {"name": "nobody", "age": 7, "loud": False}
    assert read_options("x", DECLARED, {"age": 7, "loud": "TRUE", "name": None})["loud"] is True
    for given, said in (({}, "age is missing"), ({"age": "old"}, "option age"), ({"age": 1, "loud": "so"}, "option loud"),
                        ({"age": 1, "nmae": "a"}, "nmae")):
        with pytest.raises(ValueError, match=said):
            read_options("x", DECLARED, given)
    with pytest.raises(ValueError):
        read_options("x", [Option("f", Callable, REQUIRED)], {"f": 3})


def test_listing():
    assert listed(DECLARED)[:2] == [{"key": "name", "description": "what to call it", "default": "nobody"},
                                    {"key": "age", "description": "in years", "default": ""}]


def test_sinks_by_name(spark, folder):
    @sink_connector("lake", [Option("path"), Option("by", str, "")])
    def lake(options, columns):
        return ParquetSink(options["path"], [options["by"]] if options["by"] else [])

    job = Pipeline(spark)
    job.batch_table("t", spark.range(6).selectExpr("id", "id % 2 as half"))
    job.sink(TableDef("out", [("id", "bigint"), ("half", "bigint")], options={"path": folder, "by": "half", "name": "n"}),
             "lake")
    job.insert_into("out", "SELECT id, half FROM t")
    job.run()
    assert spark.read.parquet(folder).where("half = 1").count() == 3
    with pytest.raises(ValueError, match="path is missing"):
        named_sink("lake", {}, [])
    with pytest.raises(ValueError, match="pathh"):
        named_sink("lake", {"path": "x", "pathh": "y"}, [])
    with pytest.raises(ValueError, match="url"):
        named_sink("jdbc", {"table": "t"}, [])
