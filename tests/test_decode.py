import pytest
from pyspark.sql import functions as F
from rillflow.operators import decode, quarantine
from rillflow.schema import Col, TableDef
from rillflow.sources import ENVELOPE, kafka_options, keep_from, split_hosts


def messages(spark, *values):
    rows = [("t", at % 2, None if at % 2 else b"k", None if v is None else v.encode(), at) for at, v in enumerate(values)]
    return spark.createDataFrame(rows, ENVELOPE)


def read(df):
    return [tuple(row) for row in df.orderBy("_offset").collect()]


def test_values_become_declared_types(spark):
    table = TableDef("t", [
        Col("_offset", "bigint"), Col("n", "bigint"), Col("s", "varchar"), Col("f", "boolean"), Col("d", "decimal(6,2)"),
        Col("day", "date"), Col("m", "map(varchar, array(int))"),
    ])
    got = read(decode(messages(
        spark, '{"n":5,"s":12.0,"f":true,"d":1.5,"day":"2024-02-03","m":{"a":[1,2]}}',
        '{"n":"6","s":{"x":1},"f":"no","d":"x","day":3}', '{"n":3.14}', "[1]", "broken {", None, "{}"), table))
    assert [row[:4] for row in got] == [
        (0, 5, "12.0", True), (1, 6, '{"x":1}', False), (2, None, None, None), (3, None, None, None),
        (4, None, None, None), (6, None, None, None)]
    assert str(got[0][4]) == "1.50" and str(got[0][5]) == "2024-02-03" and got[0][6] == {"a": [1, 2]}


def test_strict_mode_fails_on_a_bad_value(spark):
    table = TableDef("t", [Col("_offset", "bigint"), Col("n", "bigint")])
    assert read(decode(messages(spark, '{"n":7}'), table, strict=True)) == [(0, 7)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        decode(messages(spark, '{"n":"3.14"}'), table, strict=True).collect()


def test_paths_that_cannot_share_one_parse(spark):
    table = TableDef("t", [
        Col("_offset", "bigint"), Col("whole", "varchar", "$.a"), Col("part", "int", "$.a.b"), Col("a", "varchar"),
        Col("A", "varchar"), Col("lists", "varchar", "$.l.b"), Col("stars", "array(int)", "$.l[*].b"),
        Col("one", "varchar", "$.l[0].b"), Col("lone", "varchar", "$.s[*]"), Col("leaf", "varchar", "$.l[*].x"),
    ])
    got = read(decode(messages(spark, '{"a":{"b":1},"A":"up","l":[{"b":1},{"b":2}],"s":["q"]}'), table).toDF(
        "_offset", "whole", "part", "a1", "A2", "lists", "stars", "one", "lone", "leaf"))
    assert got == [(0, '{"b":1}', 1, '{"b":1}', "up", None, [1, 2], "1", '["q"]', "[null,null]")]
    with pytest.raises(ValueError, match="JSON path"):
        decode(messages(spark, "{}"), TableDef("t", [Col("x", "int", "$..deep")]))


def test_one_parse_per_message(spark):
    table = TableDef("t", [Col("a", "int"), Col("b", "varchar", "$.x.y"), Col("c", "double", "$.x.z")])
    plan = decode(messages(spark, "{}"), table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_quarantine_keeps_the_envelope(spark):
    table = TableDef("t", [Col("_offset", "bigint"), Col("n", "bigint"), Col("x", "varchar", "$.o.x")])
    good, bad = quarantine(messages(spark, '{"n":1}', '{"n":', "[1]", "7", '{"n":{"x":1},"o":3}', None, ""), table)
    assert [row[0] for row in read(good)] == [0, 4]
    assert [(r.offset, bytes(r.value)) for r in bad.orderBy("offset").collect()] == [
        (1, b'{"n":'), (2, b"[1]"), (3, b"7"), (6, b"")]


def test_start_positions(spark):
    rows = messages(spark, *["{}"] * 6)

    def offsets(start):
        return [r.offset for r in keep_from(rows, start).orderBy("offset").collect()]

    assert offsets("earliest") == [0, 1, 2, 3, 4, 5]
    assert offsets("latest") == []
    assert offsets({"t": {"0": 2, "1": -1}}) == [2, 4]
    assert offsets('{"t":{"0":-2,"1":3}}') == [0, 2, 3, 4, 5]
    assert offsets({"other": {"0": 9}}) == [0, 1, 2, 3, 4, 5]
    for word in ("largest", "smallest", "[]"):
        with pytest.raises(ValueError):
            keep_from(rows, word)


def test_topic_options():
    options = kafka_options({
        "kafka_topic": "a, b", "kafka_broker": "h:9092", "kafka_group_id": "g", "auto.offset.reset": "earliest",
        "value_type": "json", "maxOffsetsPerTrigger": 10, "missing": None, "kafka.group.id": "x",
    })
    assert options == {"subscribe": "a,b", "kafka.bootstrap.servers": "h:9092", "startingOffsets": "earliest",
                       "maxOffsetsPerTrigger": "10", "kafka.group.id": "x"}
    with pytest.raises(ValueError, match="json"):
        kafka_options({"kafka_topic": "a", "kafka_broker": "h", "value_type": "avro"})
    with pytest.raises(ValueError, match="largest"):
        kafka_options({"kafka_topic": "a", "kafka_broker": "h", "auto.offset.reset": "largest"})
    with pytest.raises(ValueError, match="kafka_topic"):
        kafka_options({"kafka_broker": "h"})


def test_hosts():
    assert split_hosts("a:1,b:2, a:1,c") == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        split_hosts("a,b")


def test_paths_are_kept_in_column_metadata(spark):
    table = TableDef("t", [Col("b", "varchar", "$.x.y")])
    assert decode(messages(spark, "{}"), table).schema["b"].metadata["path"] == "$.x.y"
    assert decode(messages(spark, "{}"), table).select(F.col("b")).collect()[0][0] is None
