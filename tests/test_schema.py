import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rillflow.schema import Col, ContractError, SchemaError, TableDef, contract_problem, data_type, fit_to_sink


@pytest.mark.parametrize("text, shown", [
    ("VARCHAR", "string"), ("varchar(20)", "string"), ("integer", "int"), ("long", "bigint"), ("bool", "boolean"),
    ("double  precision", "double"), ("decimal", "decimal(38,18)"), ("decimal(10,2)", "decimal(10,2)"),
    ("decimal(5)", "decimal(5,0)"), ("time", "string"), ("byte", "tinyint"), ("object", "variant"),
    ("array(int)", "array<int>"), ("array<bigint>", "array<bigint>"), ("varchar array", "array<string>"),
    ("map(string, array(int))", "map<string,array<int>>"), ("map<varchar(5),decimal(4,1)>", "map<string,decimal(4,1)>"),
    ("row(a int, b row(C varchar) array)", "struct<a:int,b:array<struct<C:string>>>"),
])
def test_type_names(text, shown):
    assert data_type(text).simpleString() == shown


@pytest.mark.parametrize("text", ["uuid", "", "map(int)", "int(3)", "row"])
def test_unknown_types(text):
    with pytest.raises(SchemaError):
        data_type(text)


def test_table_def():
    table = TableDef('db."events"', [("a", "int"), Col("b", "varchar", "$.x.y", "note")])
    assert table.name == "events"
    assert table.struct()["b"].metadata == {"path": "$.x.y", "comment": "note"}
    with pytest.raises(SchemaError):
        TableDef("t", [("a", "int"), ("a", "int")])


def test_contract_is_by_position():
    sink = TableDef("s", [("x", "bigint"), ("y", "varchar")]).struct()
    fits = T.StructType([T.StructField("other", T.LongType(), False), T.StructField("n", T.NullType())])
    assert contract_problem(fits, sink) is None
    wrong = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])
    problem = contract_problem(wrong, sink)
    assert "x string, y string" in problem and "x bigint, y string" in problem
    assert contract_problem(T.StructType(fits.fields[:1]), sink)


def test_fit_to_sink(spark):
    sink = TableDef("s", [("x", "bigint"), ("y", "varchar"), ("z", "double")]).struct()
    rows = spark.range(2).select("id", F.lit(None), F.lit(1.5))
    fitted = fit_to_sink(rows, sink)
    assert fitted.schema.simpleString() == "struct<x:bigint,y:string,z:double>"
    listed = fit_to_sink(rows.select(F.lit(2.5), "id"), sink, columns=["z", "x"])
    assert [tuple(r) for r in listed.orderBy("x").collect()] == [(0, None, 2.5), (1, None, 2.5)]
    with pytest.raises(ContractError):
        fit_to_sink(rows, sink, columns=["x", "nothing", "z"])
    with pytest.raises(ContractError):
        fit_to_sink(rows.select("id"), sink)
