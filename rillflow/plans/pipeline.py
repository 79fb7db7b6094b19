"""A job: sources, views, functions and inserts, declared in Python.

SELECT text and DataFrames are both accepted wherever a query is needed, and
nothing runs before :meth:`Pipeline.start`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.registry import register
from ..operators.decode import decode
from ..schema import Col, ContractError, TableDef, Watermark, fit_to_sink
from ..session import new_writer, scratch
from ..sources.custom import connect, gives_envelopes
from ..sources.envelope import ENVELOPE
from ..streaming import eventtime
from ..streaming.runtime import Target, fan_out, start
from ..streaming.sinks import ConsoleSink, Sink, named_sink

Query = str | DataFrame


@dataclass
class _Insert:
    name: str
    df: DataFrame
    sink: Target
    mode: str | None = None
    every: str | None = None
    checkpoint: str | None = None
    shown: str | None = None


class Pipeline:
    """Collects the statements of one job on a session."""

    def __init__(self, spark: SparkSession, checkpoint: str | None = None):
        self.spark = spark
        self.checkpoint = checkpoint
        self.tables: dict[str, DataFrame] = {}
        self.sinks: dict[str, tuple[TableDef, Target]] = {}
        self.inserts: list[_Insert] = []

    def _declare(self, name: str, df: DataFrame, watermark: Watermark | None = None, lateness: str | int = 0,
                 proctime: str | None = None) -> DataFrame:
        if watermark:
            delay = eventtime.with_lateness(watermark.delay, lateness)
            df = eventtime.event_time(df, watermark.source, delay, watermark.column)
        if proctime:
            df = eventtime.proctime(df, proctime)
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return df

    def source(self, table: TableDef, rows: DataFrame | str, strict: bool = False, lateness: str | int = 0,
               envelopes: bool | None = None) -> DataFrame:
        """A source table.

        ``rows`` is a connector name, an envelope DataFrame, which is decoded,
        or a DataFrame that already has the declared columns. ``lateness`` adds
        to the watermark delay. Whether rows are envelopes is the connector's
        to say, or ``envelopes``; a DataFrame is one if it has just the
        columns of an envelope, whatever names are declared.
        """
        if isinstance(rows, str):
            envelopes = gives_envelopes(rows) if envelopes is None else envelopes
            rows = connect(self.spark, rows, table.options, table.struct())
        names = [col.name for col in table.columns]
        if envelopes is None:
            envelopes = rows.schema.names == ENVELOPE.names and rows.schema["value"].dataType == T.BinaryType()
        if envelopes:
            rows = decode(rows, table, strict)
        else:
            rows = fit_to_sink(rows.select(*names), table.struct())
        return self._declare(table.name, rows, table.watermark, lateness, table.proctime)

    def batch_table(self, name: str, rows: DataFrame) -> DataFrame:
        """A bounded table to look rows up in."""
        if rows.isStreaming:
            raise ValueError(f"batch table {name} is a stream")
        return self._declare(name, rows)

    def view(self, name: str, query: Query, watermark: Watermark | None = None,
             lateness: str | int = 0) -> DataFrame:
        return self._declare(name, self.query(query), watermark, lateness)

    def function(self, name: str, what, returns: str | None = None, params: str | None = None) -> None:
        register(self.spark, name, what, returns, params)

    def sink(self, table: TableDef, target: Target | str) -> None:
        """A sink table; ``target`` is a sink, a connector name or a callable that starts the query.

        The table options ``outputMode``, ``name``, ``every`` and
        ``checkpoint`` set how its queries run.
        """
        if isinstance(target, str):
            target = named_sink(target, table.options, [col.name for col in table.columns])
        if table.name in self.sinks:
            raise ValueError(f"sink {table.name} is declared twice")
        self.sinks[table.name] = (table, target)

    def query(self, query: Query) -> DataFrame:
        return self.spark.sql(query) if isinstance(query, str) else query

    def insert_into(self, name: str, query: Query, columns: list[str] | None = None, mode: str | None = None,
                    fire_every: str | None = None, label: str | None = None) -> DataFrame:
        """Send a query to a sink table, checked against its columns.

        ``fire_every`` is the time between (partial) results; window results
        then appear before their window ends, in update mode. State belongs to
        the insert's sink and query text, or to its ``label``.
        """
        if name not in self.sinks:
            raise ContractError(f"no sink table {name}, there are {sorted(self.sinks)}")
        table, target = self.sinks[name]
        df = fit_to_sink(self.query(query), table.struct(), columns)
        mode = mode or table.options.get("outputMode") or ("update" if fire_every else None)
        every = fire_every or table.options.get("every")
        label = self._label(name, query, label)
        shown = table.options.get("name")
        if shown and any(insert.shown == shown for insert in self.inserts):
            shown = f"{shown}_{label}"
        root = table.options.get("checkpoint")
        self.inserts.append(_Insert(label, df, target, mode, every, f"{root}/{label}" if root else None, shown))
        return df

    def _label(self, name: str, query: Query, label: str | None = None) -> str:
        """What tells an insert from others, wherever it stands in the job: its sink and its query text.

        DataFrames have no text; they are numbered per sink, unless the caller names them. Equal ones are numbered.
        """
        if label is None and isinstance(query, str):
            label = hashlib.sha1(" ".join(query.split()).encode()).hexdigest()[:10]
        label, taken = f"{name}_{label or 'rows'}", {insert.name for insert in self.inserts}
        return next(x for x in (label, *(f"{label}_{n}" for n in range(2, 2 + len(taken)))) if x not in taken)

    def select(self, query: Query, mode: str | None = None) -> DataFrame:
        """A bare select: its rows are printed."""
        df = self.query(query)
        self.inserts.append(_Insert(self._label("select", query), df, ConsoleSink(), mode))
        return df

    def start(self) -> list[StreamingQuery]:
        """Start every insert, each streaming one with its own checkpoint; batch ones run to the end."""
        root = self.checkpoint or scratch(self.spark, "job")
        running = []
        for insert in self.inserts:
            if insert.df.isStreaming:
                state = insert.checkpoint or f"{root}/{insert.name}"
                shown = insert.shown or insert.name
                running.append(start(insert.df, insert.sink, state, insert.mode, insert.every, shown))
            elif isinstance(insert.sink, Sink):
                insert.sink.for_writer(new_writer()).write(insert.df, 0)
            else:
                insert.sink(insert.df)
        return running

    def run(self) -> None:
        """Start everything and wait for queries that end by themselves."""
        for query in self.start():
            query.awaitTermination()

    def fan_out(self, source: DataFrame, branches: list[tuple[Callable[[DataFrame], DataFrame], Sink]],
                name: str = "fan_out") -> None:
        """One query over ``source`` whose batches feed several sinks."""
        self.inserts.append(_Insert(self._label(name, source), source, fan_out(branches)))


__all__ = ["Col", "Pipeline", "TableDef", "Watermark"]
