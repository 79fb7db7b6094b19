"""Late rows to a side output, by a watermark that is known before a stateful operator sees the batch."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _fs, names
from .eventtime import interval
from .sinks import Sink


class LateSplit(Sink):
    """Hands rows at or behind the watermark to ``late`` and all others to ``kept``.

    The watermark of a batch is the latest time in the batches before it less ``delay``, in whole milliseconds, as Spark
    has it. It is written down for each batch in ``folder`` before the batch is split, so that a batch that is repeated
    after a failure is split the same way and a restarted query goes on where it stood. Rows without a time are kept.
    """

    def __init__(self, time: str, delay: str | int, kept: Sink, late: Sink, folder: str):
        self.time, self.delay, self.folder = time, interval(delay), folder
        self.kept, self.late, self.mode = kept, late, "append"

    def for_writer(self, writer: str) -> LateSplit:
        return LateSplit(self.time, self.delay, self.kept.for_writer(f"{writer}-kept"), self.late.for_writer(f"{writer}-late"),
                         f"{self.folder}/watermarks-{writer}")

    def watermark(self, spark: SparkSession, batch_id: int) -> int | None:
        """Milliseconds of the watermark in force for a batch, None before the first time was seen."""
        known = [name.split("=") for name in names(spark, self.folder)]
        reached = [int(at) for number, at in known if int(number) < batch_id]
        return max(reached) - self.delay if reached else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, F.col(self.time).cast("timestamp")
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if str(batch_id) not in {name.split("=")[0] for name in names(spark, self.folder)}:
                latest = batch.agg(F.max(F.unix_millis(at))).first()[0]
                if latest is not None:
                    fs, path = _fs(spark, f"{self.folder}/{batch_id}={latest}")
                    fs.mkdirs(path)
            mark = self.watermark(spark, batch_id)
            behind = F.lit(False) if mark is None else F.coalesce(F.unix_micros(at) <= mark * 1000, F.lit(False))
            self.kept.write(batch.where(~behind), batch_id)
            self.late.write(batch.where(behind), batch_id)
        finally:
            batch.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        """Both outputs, the late rows marked in a column ``late``."""
        return self.kept.read(spark).withColumn("late", F.lit(False)).unionByName(
            self.late.read(spark).withColumn("late", F.lit(True)))
