import pytest
from pyspark.sql import functions as F
from rillflow.operators import mutate
from rillflow.operators.coerce import to_store
from rillflow.plans.pipeline import Pipeline
from rillflow.schema import SchemaError, TableDef
from rillflow.streaming import ConsoleSink, JdbcSink, ParquetSink, RowSink, RowWriter, StatementWriter
from rillflow.streaming import ChangelogSink, CompleteSink, KeyedSink, LinesSink, MergeSink, bind_parameters, fan_out, named_sink
from rillflow.streaming.sinks import LinesWriter, _write_rows


def test_parameters_bind_by_position_and_name():
    text, bound = bind_parameters("insert into t values (${1}, ${name}, ${0})", ["a", "name", "c"])
    assert text == "insert into t values (?, ?, ?)" and bound == ["name", "name", "a"]
    assert bind_parameters("x ${0}", ["a"], "%s")[0] == "x %s"
    with pytest.raises(ValueError):
        bind_parameters("${nothing}", ["a"])


class Recorder:
    """A stand-in for a database connection that remembers what it was given."""

    def __init__(self):
        self.batches, self.commits, self.closed = [], 0, False

    def cursor(self):
        return self

    def executemany(self, statement, rows):
        self.batches.append((statement, list(rows)))

    def commit(self):
        self.commits += 1

    def close(self):
        self.closed = True


def test_statements_go_out_in_batches(spark):
    made = Recorder()
    writer = StatementWriter(lambda: made, "insert into t values (${b}, ${0})", ["a", "b"], batch_size=2)
    rows = spark.createDataFrame([(at, f"r{at}") for at in range(7)], "a int, b string").collect()
    _write_rows(writer, rows, 0, 0)
    assert [len(batch) for _, batch in made.batches] == [3, 3, 1]
    assert made.batches[0] == ("insert into t values (?, ?)", [("r0", 0), ("r1", 1), ("r2", 2)])
    assert made.commits == 3 and made.closed


def test_writer_life_cycle():
    calls = []

    class Writer(RowWriter):
        def __init__(self, accept):
            self.accept = accept

        def open(self, partition_id, version):
            calls.append(("open", partition_id, version))
            return self.accept

        def process(self, row):
            if row == "bad":
                raise ValueError("bad row")
            calls.append(row)

        def flush(self):
            calls.append("flush")

        def close(self, error):
            calls.append(("close", error and str(error)))

    _write_rows(Writer(True), ["x"], 3, 9)
    assert calls == [("open", 3, 9), "x", "flush", ("close", None)]
    calls.clear()
    _write_rows(Writer(False), ["x"], 0, 0)
    assert calls == [("open", 0, 0), ("close", None)]
    calls.clear()
    with pytest.raises(ValueError):
        _write_rows(Writer(True), ["bad"], 0, 0)
    assert calls[-1] == ("close", "bad row")


def test_row_sink_replaces_a_repeated_attempt(spark, folder):
    sink = RowSink(lambda: LinesWriter(folder))
    rows = spark.range(0, 100, 1, 4).select("id", F.lit(None).alias("n"))
    sink.write(rows, 1)
    sink.write(rows, 1)
    lines = [r[0] for r in spark.read.text(folder).collect()]
    assert sorted(lines) == sorted(f"{at},null" for at in range(100))


def test_jdbc_options():
    sink = JdbcSink("jdbc:mysql://h/db", "t", "u", "p", batch_size=10, driver="d", connections=4)
    assert sink.options == {"url": "jdbc:mysql://h/db", "dbtable": "t", "user": "u", "password": "p",
                            "batchsize": "10", "driver": "d", "numPartitions": "4"}


def test_sinks_by_name():
    assert isinstance(named_sink("console", {}, []), ConsoleSink)
    login = {"url": "jdbc:mysql://h/db", "userName": "u", "password": "p"}
    assert named_sink("jdbc", {**login, "table": "t"}, ["a"]).options["batchsize"] == "5000"
    made = Recorder()
    rows = named_sink("jdbc", {**login, "query": "insert into t values (${0})", "connect": lambda: made,
                               "batchSize": 3}, ["a"])
    writer = rows.make()
    assert isinstance(writer, StatementWriter) and writer.batch_size == 3
    for name, options in (("jdbc", login), ("jdbc", {**login, "query": "x ${b}", "connect": print}), ("other", {})):
        with pytest.raises(ValueError):
            named_sink(name, options, ["a"])
    with pytest.raises(ValueError):
        MergeSink("t", ["k"], ["seq"], "replace")


def test_console_prints_joined_rows(spark, tmp_path):
    shown = str(tmp_path / "shown")

    def emit(line):
        with open(shown, "a") as out:
            out.write(line + "\n")

    ConsoleSink(emit).write(spark.range(2).coalesce(1).select("id", F.lit(None).cast("string"), F.lit("x")), 0)
    assert open(shown).read() == "0,null,x\n1,null,x\n"


def test_batches_are_replaced_not_added(spark, folder):
    sink = ParquetSink(folder)
    sink.write(spark.range(3), 0)
    sink.write(spark.range(5), 0)
    sink.write(spark.range(2), 1)
    assert sink.read(spark).count() == 7


def test_changelog_gives_the_newest_row(spark, folder):
    sink = ChangelogSink(folder, ["k"])
    sink.write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), 0)
    sink.write(spark.createDataFrame([("a", 2)], "k string, n int"), 1)
    assert sorted(map(tuple, sink.read(spark).collect())) == [("a", 2), ("b", 1)]
    sink.compact(spark)
    assert sorted(map(tuple, sink.read(spark).collect())) == [("a", 2), ("b", 1)]


def test_fan_out_skips_empty_batches(spark, folder):
    seen = []

    class Count(ParquetSink):
        def write(self, batch, batch_id):
            seen.append((batch_id, batch.count()))

    sink = fan_out([(lambda b: b, Count(folder)), (lambda b: b.filter("id > 1"), Count(folder))])
    sink.write(spark.range(3), 4)
    sink.write(spark.range(0), 5)
    assert seen == [(4, 3), (4, 1)]


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, s string, n int")


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(2, "x", 21, 1), (2, "y", 22, 2), (3, None, 30, 1), (3, "w", 31, 2)],
                                 "id int, s string, n int, seq int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_keyed_changes(target, batch):
    assert rows(mutate.insert_new(target, batch, ["id"], ["seq"])) == [(1, "a", 10), (2, "b", 20), (3, None, 30)]
    assert rows(mutate.upsert(target, batch, ["id"], ["seq"])) == [(1, "a", 10), (2, "y", 22), (3, "w", 31)]
    assert rows(mutate.update(target, batch, ["id"], ["seq"])) == [(1, "a", 10), (2, "y", 22)]
    assert rows(mutate.delete(target, batch, ["id"])) == [(1, "a", 10)]
    assert rows(mutate.accumulate(target, batch.drop("s", "seq"), ["id"], ["n"])) == [
        (1, "a", 10), (2, "b", 63), (3, None, 61)]


def test_update_can_set_null(spark, target):
    change = spark.createDataFrame([(1, None, 5, 1)], "id int, s string, n int, seq int")
    assert rows(mutate.update(target, change, ["id"], ["seq"])) == [(1, None, 5), (2, "b", 20)]


def test_store_types(spark):
    moment = spark.sql("select timestamp'2024-01-01 00:00:01' t, date'1970-01-02' d, 5 i, 1.5D x, true b, null z")
    got = to_store(moment, {"t": "bigint", "d": "bigint", "i": "varchar", "x": "float", "b": "boolean", "z": "int"})
    assert tuple(got.first()) == (1704067201000, 86400000, "5", 1.5, True, None)
    for name, kind in (("b", "bigint"), ("x", "int"), ("i", "double"), ("t", "date")):
        with pytest.raises(SchemaError):
            to_store(moment, {name: kind})


def ids(rows):
    return sorted(row[0] for row in rows.collect())


def test_branches_of_one_sink_keep_all_rows(spark, folder, tmp_path):
    sink = ParquetSink(folder)
    both = fan_out([(lambda b: b.filter("id % 2 = 0"), sink), (lambda b: b.filter("id % 2 = 1"), sink)])
    both = both.for_writer("w")
    for _ in range(2):                                  # the second time is a retry
        both.write(spark.range(100), 0)
    assert ids(sink.read(spark)) == list(range(100))


def test_state_follows_query_text_and_not_its_place(spark, folder):
    def job(queries, options=None):
        made = Pipeline(spark, folder)
        made.batch_table("t", spark.range(3))
        made.sink(TableDef("out", [("id", "bigint")], options=options or {}), ParquetSink(folder + "x"))
        for query in queries:
            made.insert_into("out", query)
        return {i.name: (i.checkpoint, i.shown) for i in made.inserts}

    a, b = "SELECT id FROM t", "SELECT id + 1 FROM t"
    assert job([a, b]) == job([b, a]) and set(job([a])) < set(job(["SELECT id + 2 FROM t", a]))
    assert len(job([a, a])) == 2
    named = job([a, b], {"name": "n", "checkpoint": "c"})
    assert len({c for c, _ in named.values()}) == 2 and len({n for _, n in named.values()}) == 2


def test_changelog_stays_bounded(spark, tmp_path):
    sink = ChangelogSink(f"file:{tmp_path}/log", ["k"], deleted="gone", compact_every=3)
    for batch in range(24):
        rows = [(k, batch, k == 4 and batch >= 6) for k in range(5) if k < 4 or batch < 7]
        sink.write(spark.createDataFrame(rows, "k int, v int, gone boolean"), batch)
        want = [(k, batch) for k in range(4)] + ([(4, batch)] if batch < 6 else [])
        assert sorted(tuple(r) for r in sink.read(spark).collect()) == want
    kept = list(tmp_path.glob("log/changes/*/batch_id=*"))
    assert len(kept) <= 6 and len(list(tmp_path.glob("log/base/*"))) <= 2
    newest = sorted(tmp_path.glob("log/base/*"))[-1]
    assert spark.read.parquet(f"file:{newest}/rows").count() == 4      # the deletion itself is gone by now


def test_complete_sink_keeps_two_batches(spark, tmp_path):
    sink = CompleteSink(f"file:{tmp_path}/all")
    for batch in range(12):
        sink.write(spark.range(batch), batch)
        assert sink.read(spark).count() == batch
    assert len(list(tmp_path.glob("all/*/batch_id=*"))) == 2


@pytest.mark.parametrize("change, want", [
    ("insert", {1: "a", 2: "c", 3: "x"}), ("upsert", {1: "b", 2: "d", 3: "x"}), ("update", {1: "b", 3: "x"}),
    ("delete", {3: "x"}),
])
def test_keyed_sink(spark, folder, change, want):
    start = spark.createDataFrame([(1, "a"), (3, "x")], "k int, v string")
    sink = KeyedSink(folder, ["k"], ["at"], change, start=start).for_writer("w")
    batches = [[(1, "b", 1), (2, "c", 1), (2, "d", 2)], [(9, "e", 1)]]
    schema = "k int, v string, at int"
    for batch_id, rows in enumerate(batches):
        for _ in range(2):
            sink.write(spark.createDataFrame(rows, schema), batch_id)
    more = {"insert": {9: "e"}, "upsert": {9: "e"}}.get(change, {})
    assert {r.k: r.v for r in sink.read(spark).collect()} == want | more


def test_keyed_sink_adds_up_once_and_coerces(spark, folder):
    start = spark.createDataFrame([("a", 5)], "k string, n bigint")
    sink = KeyedSink(folder, ["k"], change="accumulate", values=["n"], types={"k": "string"}, start=start).for_writer("w")
    for batch_id, k in enumerate([7, 7, 8]):
        for _ in range(2):
            sink.write(spark.createDataFrame([(k, 1)], "k int, n bigint"), batch_id)
    assert {r.k: r.n for r in sink.read(spark).collect()} == {"a": 5, "7": 2, "8": 1}


def test_lines_of_a_repeated_batch(spark, tmp_path):
    sink = LinesSink(f"file:{tmp_path}/lines").for_writer("w")
    sink.write(spark.range(100).repartition(4), 0)
    sink.write(spark.range(100).repartition(2), 0)
    assert spark.read.option("recursiveFileLookup", "true").text(f"file:{tmp_path}/lines").count() == 100
