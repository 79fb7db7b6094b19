"""Starting queries: output mode, trigger, checkpoint and micro-batch work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import writer_of
from .eventtime import interval
from .sinks import Sink

Target = Sink | Callable[[DataFrame], StreamingQuery]


def start(df: DataFrame, sink: Target, checkpoint: str, mode: str | None = None, every: str | None = None,
          name: str | None = None) -> StreamingQuery:
    """Start one query with its own checkpoint.

    ``every`` is the time between micro-batches; without it the query takes
    what is there and ends. A callable sink starts the query itself. The
    checkpoint says which writer the query is to its sink.
    """
    if not isinstance(sink, Sink):
        return sink(df)
    sink = sink.for_writer(writer_of(df.sparkSession, checkpoint))
    writer = df.writeStream.outputMode(mode or sink.mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if every:
        writer = writer.trigger(processingTime=f"{interval(every)} milliseconds")
    else:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(sink.write).start()


def drain(df: DataFrame, sink: Target, checkpoint: str, mode: str | None = None) -> None:
    """Run a query over everything available and wait for its end."""
    start(df, sink, checkpoint, mode).awaitTermination()


class _Shared(Sink):
    """One batch, computed once, handed to several sinks in order, each branch being a writer of its own."""

    def __init__(self, branches: Sequence[tuple[Callable[[DataFrame], DataFrame], Sink]]):
        self.branches = [(derive, sink.for_writer(f"branch{at}")) for at, (derive, sink) in enumerate(branches)]

    def for_writer(self, writer: str) -> Sink:
        own = _Shared([])
        own.branches = [(derive, sink.for_writer(f"{writer}-{at}")) for at, (derive, sink) in enumerate(self.branches)]
        return own

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if batch.isEmpty():
                return
            for derive, sink in self.branches:
                sink.write(derive(batch), batch_id)
        finally:
            batch.unpersist()


def fan_out(branches: Sequence[tuple[Callable[[DataFrame], DataFrame], Sink]]) -> Sink:
    """A sink that derives one result per branch from each batch; empty batches are skipped."""
    return _Shared(branches)


def micro_batch_sql(view: str, statements: Sequence[tuple[str, Sink]]) -> Sink:
    """A sink that shows each batch as ``view`` and runs SQL statements on it in order.

    The statements are batch queries, so OVER functions, INTERSECT, EXCEPT and
    sorting work on streams too, within a batch.
    """

    def derive(text):
        def run(batch: DataFrame) -> DataFrame:
            batch.createOrReplaceTempView(view)
            return batch.sparkSession.sql(text)

        return run

    return _Shared([(derive(text), sink) for text, sink in statements])
