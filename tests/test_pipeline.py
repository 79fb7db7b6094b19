import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from rillflow import Col, ContractError, Pipeline, TableDef, Watermark
from rillflow.functions import Accumulator, aggregate_by, register
from rillflow.plans.catalog.functions import Spread
from rillflow.session import scratch
from rillflow.sources import ENVELOPE, connect, connector
from rillflow.streaming import CompleteSink, ConsoleSink, ParquetSink
from rillflow.streaming.eventtime import event_time, interval

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def job(spark):
    return Pipeline(spark)


def test_sample_job(spark, job, folder):
    """Messages to windowed counts, as a batch."""
    body = [f'{{"user_id":"u{at % 3}","nested":{{"at":{1704067200000 + at * 1000}}}}}'.encode() for at in range(12)]
    rows = spark.createDataFrame([("t", 0, b"k", value, at) for at, value in enumerate(body)], ENVELOPE)
    job.source(TableDef("messages", [Col("user_id", "varchar"), Col("event_time", "bigint", "$.nested.at"),
                                     Col("_key", "varchar")],
                        watermark=Watermark("event_time", "5 seconds"), proctime="seen"), rows)
    sink = ParquetSink(folder)
    job.sink(TableDef("counts", [("who", "varchar"), ("n", "long"), ("since", "timestamp")]), sink)
    job.insert_into("counts", """SELECT user_id, count(*), window.start FROM messages WHERE _key IS NOT NULL
                                 AND seen IS NOT NULL GROUP BY user_id, window(rowtime, '6 seconds')""")
    job.run()
    assert sorted((r.who, r.n) for r in sink.read(spark).collect()) == sorted([("u0", 2), ("u1", 2), ("u2", 2)] * 2)


def test_append_and_grouped_values(spark, job):
    assert [r[0] for r in job.query("SELECT * FROM VALUES ('Bob'), ('Bob') AS t(name)").collect()] == ["Bob", "Bob"]
    counted = job.query("SELECT name, count(*) FROM VALUES ('Bob'), ('Bob') AS t(name) GROUP BY name")
    assert [tuple(r) for r in counted.collect()] == [("Bob", 2)]


def test_bare_select_is_printed(spark, job):
    rows = job.select("SELECT 1 AS a, cast(null AS string) AS b")
    assert isinstance(job.inserts[-1].sink, ConsoleSink) and job.inserts[-1].df is rows
    job.run()


def test_strict_cast_fails(job):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        job.query("SELECT cast(age AS bigint) FROM VALUES ('a1', '3.14') AS t(name, age)").collect()


def test_untyped_null_has_no_type_of_its_own(job):
    assert isinstance(job.query("SELECT null AS n").schema["n"].dataType, T.NullType)


def test_sink_errors(spark, job, folder):
    job.sink(TableDef("out", [("a", "bigint")]), ParquetSink(folder))
    with pytest.raises(ContractError, match="no sink table other"):
        job.insert_into("other", "SELECT 1L")
    with pytest.raises(ContractError, match="a bigint"):
        job.insert_into("out", "SELECT 'text' AS t")
    with pytest.raises(ValueError, match="twice"):
        job.sink(TableDef("out", [("a", "bigint")]), ParquetSink(folder))


def test_batch_table_must_be_bounded(spark, job, folder):
    spark.range(1).write.parquet(folder)
    with pytest.raises(ValueError):
        job.batch_table("dim", spark.readStream.schema("id bigint").parquet(folder))


def test_stream_sink_callable(spark, job, folder):
    spark.range(5).write.parquet(folder)
    out = scratch(spark, "callable")

    def native(df):
        return df.writeStream.format("parquet").option("path", out + "/rows").option(
            "checkpointLocation", out + "/state").trigger(availableNow=True).start()

    job.source(TableDef("feed", [("id", "bigint")]), spark.readStream.schema("id bigint").parquet(folder))
    job.sink(TableDef("out", [("id", "bigint")]), native)
    job.insert_into("out", "SELECT id FROM feed")
    job.run()
    assert spark.read.parquet(out + "/rows").count() == 5


def test_many_inserts_have_their_own_checkpoints(spark, job, folder):
    spark.range(4).write.parquet(folder)
    a, b = ParquetSink(folder + "-a"), ParquetSink(folder + "-b")
    job.source(TableDef("feed", [("id", "bigint")]), spark.readStream.schema("id bigint").parquet(folder))
    for name, sink in (("a", a), ("b", b)):
        job.sink(TableDef(name, [("id", "bigint")], options={"name": f"to_{name}"}), sink)
    job.insert_into("a", "SELECT id FROM feed")
    job.insert_into("b", "SELECT id FROM feed WHERE id > 1")
    job.run()
    assert (a.read(spark).count(), b.read(spark).count()) == (4, 2)


def test_sink_options_name_the_query_and_its_state(spark, job, folder):
    spark.range(4).write.parquet(folder)
    state, sink = scratch(spark, "own-state"), CompleteSink(folder + "-out")
    job.source(TableDef("feed", [("id", "bigint")]), spark.readStream.schema("id bigint").parquet(folder))
    job.sink(TableDef("out", [("n", "bigint")], options={
        "outputMode": "complete", "name": "counted", "checkpoint": state}), sink)
    job.insert_into("out", "SELECT count(*) FROM feed")
    query, = job.start()
    query.awaitTermination()
    assert query.name == "counted" and sink.read(spark).first().n == 4
    insert, = job.inserts
    assert spark.read.text(f"{state}/{insert.name}/metadata").count() == 1


def test_line_source_knows_its_hosts(spark):
    lines = connect(spark, "socket", {"socket_hosts": "a:1,b:2"}, None)
    assert lines.isStreaming and lines.columns == ["host", "port", "value"]
    with pytest.raises(ValueError):
        connect(spark, "socket", {}, None)


class Numbers(DataSource):
    @classmethod
    def name(cls):
        return "test_numbers"

    def schema(self):
        return "n bigint"

    def reader(self, schema):
        upto = int(self.options["upto"])

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(0), InputPartition(1)]

            def read(self, part):
                return iter([(n,) for n in range(upto) if n % 2 == part.value])

        return Reader()


def test_custom_connectors(spark):
    connector("numbers")(Numbers)
    schema = T.StructType([T.StructField("n", T.LongType())])
    assert connect(spark, "numbers", {"upto": 5}, schema, stream=False).count() == 5

    @connector("plain")
    def plain(session, options, wanted):
        return session.range(int(options["n"])).toDF(*wanted.names)

    assert connect(spark, "plain", {"n": 3}, schema).columns == ["n"]


def test_functions(spark):
    register(spark, "twice_sql", "x * 2", "int", "x int")
    register(spark, "twice_py", lambda x: x * 2, "bigint")
    assert tuple(spark.sql("SELECT twice_sql(4), twice_py(id) FROM range(5, 6)").first()) == (8, 10)
    with pytest.raises(TypeError):
        register(spark, "untyped", lambda x: x)
    with pytest.raises(TypeError):
        register(spark, "wrong", 5)


class Total(Accumulator):
    state, result = "total double, n bigint", "double"

    def zero(self):
        return (0.0, 0)

    def add(self, state, values: pd.DataFrame):
        return state[0] + float(values.iloc[:, 0].sum()), state[1] + len(values)

    def merge(self, left, right):
        return left[0] + right[0], left[1] + right[1]

    def finish(self, state):
        return state[0] / state[1]


def test_accumulator_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 16).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("v"))
    rows = rows.withColumn("k", F.when(F.col("k") != "2", F.col("k")))
    got = {r.k: r.m for r in aggregate_by(rows, ["k"], Total(), ["v"], "m").collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.avg("v").alias("m")).collect()}
    assert got == pytest.approx(want)
    register(spark, "spread", Spread)
    assert aggregate_by(rows, ["k"], "spread", ["v"], "s").count() == 3


def test_intervals():
    assert [interval(t) for t in ("5 seconds", "1 MINUTE", "2 hours", "1 day", "250 milliseconds", 250, "7")] == [
        5_000, 60_000, 7_200_000, 86_400_000, 250, 250, 7]
    for bad in ("5 fortnights", "a b c"):
        with pytest.raises(ValueError):
            interval(bad)


def test_event_time_from_epoch_and_timestamps(spark):
    rows = spark.sql("select 1704067200123L ms, timestamp_ntz'2024-01-01 00:00:00.123' ntz")
    a = event_time(rows, "ms", "1 second").select(F.unix_millis("rowtime")).first()[0]
    b = event_time(rows, "ntz", 500).select(F.unix_millis("rowtime")).first()[0]
    assert a == b == 1704067200123
