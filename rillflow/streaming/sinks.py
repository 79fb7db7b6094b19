"""Where rows go.

A sink takes micro-batches through ``write(batch, batch_id)`` and the same call
serves batch data. Writes are keyed by writer and batch id, so a batch that is
run again after a failure replaces its first attempt and nothing else.
"""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import mutate
from ..operators.coerce import row_text, to_store
from ..operators.mutate import latest_by_key, merge_into
from ..options import JOB_OPTIONS, Option, read_options
from ..session import exists, names, remove

WRITER, BATCH = "writer_id", "batch_id"


class Sink:
    """Base of all sinks; ``mode`` is the output mode its queries use by default."""

    mode = "append"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def for_writer(self, writer: str) -> Sink:
        """This sink as one writer sees it; sinks that keep no batches apart are the same for all."""
        return self


class ParquetSink(Sink):
    """One ``writer_id=w/batch_id=n`` folder per micro-batch, replaced when that writer repeats the batch.

    Batch numbers are only unique for one checkpoint, so what other inserts, branches and runs write goes
    elsewhere. Rows written without a writer are those of the writer ``direct``.
    """

    def __init__(self, path: str, partition_by: Sequence[str] = ()):
        self.path = path
        self.partition_by = list(partition_by)
        self.writer = "direct"

    def for_writer(self, writer: str) -> Sink:
        own = copy.copy(self)
        own.writer = writer
        return own

    def write(self, batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/{WRITER}={self.writer}/{BATCH}={batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows written so far, with the writer and batch that wrote them."""
        return spark.read.option("basePath", self.path).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).drop(WRITER, BATCH)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """``writer_id=w/batch_id=n`` of every batch below ``path``, oldest first."""
    found = []
    for writer in names(spark, path):
        if writer.startswith(f"{WRITER}="):
            found += [(writer, int(name.split("=")[1])) for name in names(spark, f"{path}/{writer}")
                      if name.startswith(f"{BATCH}=")]
    return [f"{writer}/{BATCH}={batch}" for writer, batch in sorted(found)]


class ChangelogSink(Sink):
    """Keyed results: every batch adds its changed rows, the newest per key counts.

    A batch costs what it changes, never a rewrite of the table. After every ``compact_every`` batches the changes
    are folded into a base table, which readers use. ``deleted`` names a boolean column that says a key is gone.
    Folded batches and the base before go one compaction later, so that running readers are not disturbed; by then
    nothing older than a deletion is left, and it goes as well. Batches of a later writer count as newer.
    """

    mode = "update"

    def __init__(self, path: str, keys: Sequence[str], deleted: str | None = None, compact_every: int = 50):
        self.path, self.keys, self.deleted, self.compact_every = path, list(keys), deleted, compact_every
        self.changes = ParquetSink(f"{path}/changes")

    def for_writer(self, writer: str) -> Sink:
        own = copy.copy(self)
        own.changes = self.changes.for_writer(writer)
        return own

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.changes.write(batch, batch_id)
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact(batch.sparkSession)

    def _bases(self, spark: SparkSession) -> list[str]:
        """Complete bases, oldest first."""
        root = f"{self.path}/base"
        return [f"{root}/{name}" for name in names(spark, root) if exists(spark, f"{root}/{name}/rows/_SUCCESS")]

    def _latest(self, spark: SparkSession, folders: list[str], base: str | None) -> DataFrame:
        """The newest row per key with its writer and batch, deletions included."""
        parts = []
        if base:
            parts.append(spark.read.parquet(f"{base}/rows"))
        if folders:
            root = self.changes.path
            new = spark.read.option("basePath", root).parquet(*[f"{root}/{name}" for name in folders])
            parts.append(new.withColumn(WRITER, F.col(WRITER).cast("string")).withColumn(
                BATCH, F.col(BATCH).cast("long")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return latest_by_key(rows, self.keys, [WRITER, BATCH])

    def read(self, spark: SparkSession) -> DataFrame:
        base = (self._bases(spark) or [None])[-1]
        rows = self._latest(spark, _folders(spark, self.changes.path), base).drop(WRITER, BATCH)
        return rows.filter(~F.coalesce(self.deleted, F.lit(False))).drop(self.deleted) if self.deleted else rows

    def compact(self, spark: SparkSession) -> None:
        """Folds what has been written into a new base."""
        bases = self._bases(spark)
        base = bases[-1] if bases else None
        if base:
            for row in spark.read.parquet(f"{base}/folded").collect():      # one row per folded batch
                remove(spark, f"{self.changes.path}/{row['folder']}")
            for old in bases[:-1]:
                remove(spark, old)
        folders = _folders(spark, self.changes.path)
        if not folders:
            return
        rows = self._latest(spark, folders, base)
        if self.deleted and base:
            # what was already deleted in the base has no older rows any more
            gone = spark.read.parquet(f"{base}/rows").filter(F.col(self.deleted)).select(*self.keys, WRITER, BATCH)
            rows = rows.join(gone, [*self.keys, WRITER, BATCH], "left_anti").select(*rows.columns)
        number = int(base.rsplit("=", 1)[1]) + 1 if base else 0
        target = f"{self.path}/base/version={number:010d}"
        folded = spark.createDataFrame([(name,) for name in folders], "folder string")
        folded.write.mode("overwrite").parquet(f"{target}/folded")
        rows.write.mode("overwrite").parquet(f"{target}/rows")


class CompleteSink(ParquetSink):
    """Whole results: the newest batch of the newest writer replaces all earlier ones, which are removed but for one."""

    mode = "complete"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        super().write(batch, batch_id)
        spark = batch.sparkSession
        for old in _folders(spark, self.path)[:-2]:
            remove(spark, f"{self.path}/{old}")

    def read(self, spark: SparkSession) -> DataFrame:
        newest = _folders(spark, self.path)[-1]
        return spark.read.parquet(f"{self.path}/{newest}")


class KeyedSink(Sink):
    """A table that batches insert into, upsert, update, delete from or accumulate in, by key.

    Batch by batch, version *n* is read and version *n + 1* written beside it; a version counts once its last part,
    the list of batches applied so far, is there. A repeated batch is already in that list and changes nothing. The
    version before the newest stays for running readers, older ones go. ``types`` coerces columns to what the table
    holds. One writer at a time: the whole table is rewritten per batch, so this is for tables that are small beside
    their stream; ``ChangelogSink`` is for others.
    """

    mode = "update"

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str] = (), change: str = "upsert",
                 values: Sequence[str] = (), types: dict[str, str] | None = None, start: DataFrame | None = None):
        if change not in ("insert", "upsert", "update", "delete", "accumulate"):
            raise ValueError(f"unknown change {change!r}")
        if not order and change in ("insert", "upsert", "update"):
            raise ValueError(f"{change} needs the columns that order the rows of a key")
        self.path, self.keys, self.order, self.change = path, list(keys), list(order), change
        self.values, self.types, self.first, self.writer = list(values), types, start, "direct"

    def for_writer(self, writer: str) -> Sink:
        own = copy.copy(self)
        own.writer = writer
        return own

    def _versions(self, spark: SparkSession) -> list[str]:
        return [f"{self.path}/{name}" for name in names(spark, self.path)
                if exists(spark, f"{self.path}/{name}/applied/_SUCCESS")]

    def _stored(self, batch: DataFrame) -> DataFrame:
        held = {name: batch.schema[name].dataType for name in batch.columns}
        return to_store(batch, {**held, **self.types}) if self.types else batch

    def _next(self, table: DataFrame, batch: DataFrame) -> DataFrame:
        if self.change == "delete":
            return mutate.delete(table, batch, self.keys)
        if self.change == "accumulate":
            return mutate.accumulate(table, batch, self.keys, self.values)
        change = {"insert": mutate.insert_new, "upsert": mutate.upsert, "update": mutate.update}[self.change]
        return change(table, batch, self.keys, self.order)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark, versions = batch.sparkSession, self._versions(batch.sparkSession)
        applied: dict[str, int] = {}
        if versions:
            applied = {row[0]: row[1] for row in spark.read.parquet(f"{versions[-1]}/applied").collect()}
            if applied.get(self.writer, -1) >= batch_id:
                return
        batch = self._stored(batch)
        if versions:
            table = spark.read.parquet(f"{versions[-1]}/rows")
        elif self.first is not None:
            table = self.first
        else:
            held = [name for name in batch.columns if name in self.keys or name not in self.order]
            table = batch.select(*held).limit(0)
        number = int(versions[-1].rsplit("=", 1)[1]) + 1 if versions else 0
        target = f"{self.path}/version={number:010d}"
        self._next(table, batch).write.mode("overwrite").parquet(f"{target}/rows")
        applied[self.writer] = batch_id
        spark.createDataFrame(list(applied.items()), "writer string, batch long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{target}/applied")
        for old in versions[:-1]:
            remove(spark, old)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self._versions(spark)[-1]}/rows")


def _print(line: str) -> None:
    print(line, flush=True)


class ConsoleSink(Sink):
    """Prints each row on the executor that holds it, values joined by commas."""

    def __init__(self, emit: Callable[[str], None] = _print):
        self.emit = emit

    def write(self, batch: DataFrame, batch_id: int) -> None:
        emit = self.emit

        def show(rows: Iterable[Row]) -> None:
            for row in rows:
                emit(row[0])

        batch.select(row_text(batch)).foreachPartition(show)


# Fixed value: a template parameter, ``${0}`` by position or ``${name}`` by name.
PARAMETER = re.compile(r"\$\{(.+?)\}")


def bind_parameters(template: str, columns: Sequence[str], placeholder: str = "?") -> tuple[str, list[str]]:
    """Statement text with placeholders and the column behind each of them."""
    names = PARAMETER.findall(template)
    bound = [columns[int(name)] if name.isdigit() else name for name in names]
    missing = [name for name in bound if name not in columns]
    if missing:
        raise ValueError(f"parameters {missing} are not columns of {list(columns)}")
    return PARAMETER.sub(lambda _: placeholder, template), bound


def bind_columns(df: DataFrame, template: str) -> DataFrame:
    """Columns of ``df`` in the order the template uses them, numbered ``p1``, ``p2``, …"""
    _, bound = bind_parameters(template, df.columns)
    return df.select(*[F.col(f"`{name}`").alias(f"p{at}") for at, name in enumerate(bound, 1)])


class JdbcSink(Sink):
    """Appends to a database table through Spark's JDBC writer."""

    def __init__(self, url: str, table: str, user: str, password: str, batch_size: int = 5000,
                 driver: str | None = None, connections: int | None = None):
        self.options = {"url": url, "dbtable": table, "user": user, "password": password,
                        "batchsize": str(batch_size)}
        if driver:
            self.options["driver"] = driver
        if connections:
            self.options["numPartitions"] = str(connections)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.format("jdbc").options(**self.options).mode("append").save()


class MergeSink(Sink):
    """Applies batches to a catalog table that supports row-level changes.

    ``change`` is insert, upsert, update or delete. ``order`` picks the last row
    of a key within a batch.
    """

    mode = "update"

    def __init__(self, table: str, keys: Sequence[str], order: Sequence[str], change: str = "upsert"):
        if change not in ("insert", "upsert", "update", "delete"):
            raise ValueError(f"unknown change {change!r}")
        self.table, self.keys, self.order, self.change = table, list(keys), list(order), change

    def write(self, batch: DataFrame, batch_id: int) -> None:
        merge_into(batch, self.table, self.keys, self.order, self.change)


class RowWriter:
    """Row-wise output of one partition.

    ``open`` may refuse a partition by returning False. ``close`` is called in
    every case and gets the error that ended the partition, if any.
    """

    def open(self, partition_id: int, version: int) -> bool:
        return True

    def process(self, row: Row) -> None:
        raise NotImplementedError

    def flush(self) -> None:
        pass

    def close(self, error: Exception | None) -> None:
        pass


def _write_rows(writer: RowWriter, rows: Iterable[Row], partition_id: int, version: int) -> None:
    failure = None
    try:
        if writer.open(partition_id, version):
            for row in rows:
                writer.process(row)
            writer.flush()
    except Exception as error:
        failure = error
        raise
    finally:
        writer.close(failure)


class StatementWriter(RowWriter):
    """Runs a template statement such as ``insert into t values (${0}, ${name})`` per row.

    ``connect`` gives a DB-API connection on the executor. Rows are sent in
    batches, and a batch goes out once it holds more than ``batch_size`` rows.
    """

    def __init__(self, connect: Callable, template: str, columns: Sequence[str], batch_size: int = 5000,
                 placeholder: str = "?"):
        self.connect = connect
        self.statement, self.bound = bind_parameters(template, columns, placeholder)
        self.batch_size = batch_size
        self.connection = None
        self.queue: list[tuple] = []

    def open(self, partition_id: int, version: int) -> bool:
        self.connection, self.queue = self.connect(), []
        return True

    def process(self, row: Row) -> None:
        self.queue.append(tuple(row[name] for name in self.bound))
        if len(self.queue) > self.batch_size:
            self.flush()

    def flush(self) -> None:
        if self.queue:
            self.connection.cursor().executemany(self.statement, self.queue)
            self.connection.commit()
            self.queue = []

    def close(self, error: Exception | None) -> None:
        if self.connection is not None:
            self.connection.close()


class LinesWriter(RowWriter):
    """Writes a partition's rows as text lines below a shared folder.

    A file is written under a name of its own attempt and then renamed to that of version and partition, so of
    attempts that run side by side the one that ends last stays whole. ``LinesSink`` clears a version before it is
    written again, as another attempt may have fewer partitions.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.out = None

    def open(self, partition_id: int, version: int) -> bool:
        self.files, root = open_folder(self.folder)
        self.files.create_dir(f"{root}/version={version}", recursive=True)
        self.name = f"{root}/version={version}/p{partition_id}.txt"
        self.draft = f"{root}/version={version}/_p{partition_id}-{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.draft)
        return True

    def process(self, row: Row) -> None:
        self.out.write((",".join("null" if value is None else str(value) for value in row) + "\n").encode())

    def close(self, error: Exception | None) -> None:
        if self.out is not None:
            self.out.close()
            if error is None:
                self.files.move(self.draft, self.name)
            else:
                self.files.delete_file(self.draft)


def open_folder(folder: str):
    """Arrow file system and path of a folder given as path or URI."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class RowSink(Sink):
    """Feeds partitions to row writers; ``make()`` runs on the executor."""

    def __init__(self, make: Callable[[], RowWriter]):
        self.make = make

    def write(self, batch: DataFrame, batch_id: int) -> None:
        make = self.make

        def feed(rows: Iterable[Row]) -> None:
            _write_rows(make(), rows, TaskContext.get().partitionId(), batch_id)

        batch.foreachPartition(feed)


class LinesSink(RowSink):
    """Text lines below a folder; a repeated batch replaces all that its first attempt wrote."""

    def __init__(self, folder: str):
        super().__init__(lambda: LinesWriter(folder))
        self.folder = folder

    def for_writer(self, writer: str) -> Sink:
        return LinesSink(f"{self.folder}/{WRITER}={writer}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        remove(batch.sparkSession, f"{self.folder}/version={batch_id}")
        super().write(batch, batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").text(self.folder)


Maker = Callable[[dict, Sequence[str]], Sink]

_connectors: dict[str, tuple[Maker, tuple[Option, ...]]] = {}


def sink_connector(name: str, options: Sequence[Option] = ()):
    """Register a sink: a callable ``(options, columns)`` that makes it, with the options it declares."""

    def keep(make: Maker) -> Maker:
        _connectors[name] = (make, tuple(options))
        return make

    return keep


def sink_options(name: str) -> tuple[Option, ...]:
    """The options that a sink connector declares."""
    if name not in _connectors:
        raise ValueError(f"unknown sink connector {name!r}, there are {sorted(_connectors)}")
    return _connectors[name][1]


def named_sink(name: str, options: dict, columns: Sequence[str]) -> Sink:
    """A sink by connector name, from its declared options."""
    declared = sink_options(name)
    return _connectors[name][0](read_options(f"sink {name}", declared, options, JOB_OPTIONS), columns)


@sink_connector("console")
def _console(options: dict, columns: Sequence[str]) -> Sink:
    return ConsoleSink()


@sink_connector("jdbc", [
    Option("url", str, None, "JDBC address, for a table"),
    Option("table", str, None, "table to append to"),
    Option("userName", str, None, "who logs in"),
    Option("password", str, None, "the password"),
    Option("driver", str, None, "driver class, if the address does not tell"),
    Option("query", str, None, "statement template with ${0} or ${name} parameters, instead of a table"),
    Option("connect", Callable, None, "opens a DB-API connection on an executor, for a query"),
    Option("placeholder", str, "?", "how the driver writes a parameter"),
    Option("batchSize", int, 5000, "rows sent at once"),
])
def _jdbc(options: dict, columns: Sequence[str]) -> Sink:
    if options["table"]:
        missing = [name for name in ("url", "userName", "password") if options[name] is None]
        if missing:
            raise ValueError(f"sink jdbc: a table needs the options {missing}")
        return JdbcSink(options["url"], options["table"], options["userName"], options["password"],
                        options["batchSize"], options["driver"])
    if not options["query"] or not options["connect"]:
        raise ValueError("sink jdbc: it needs a table, or a query with connect")
    connect, query, mark, size = (options[name] for name in ("connect", "query", "placeholder", "batchSize"))
    bind_parameters(query, columns, mark)
    return RowSink(lambda: StatementWriter(connect, query, columns, size, mark))
