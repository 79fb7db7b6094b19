"""What the training-data operators share: their catalogue, written stages, and a fixed-size broadcast filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

Run = Callable[[SparkSession, str], DataFrame]
Batches = Iterator[pa.RecordBatch]

WORD = r"[^\x20\x09-\x0D]+"     # a word, wherever a contract speaks of words
GAP = r"[\x20\x09-\x0D]+"       # what lies between two of them
BIT_BLOCK = 1 << 16             # bits of a filter that one group builds
BATCH_BYTES = 1 << 20           # of a batch that goes to a Python worker, where texts may be long
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query over whole tables, with the SQL that must agree with it if SQL can say it."""

    def keep(run: Run) -> Run:
        CATALOG[name] = Entry(run, sql)
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names, so that further columns of the caller can't clash with working columns."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """From now on a Python worker gets at most some ``BATCH_BYTES`` at once, whatever the number and size of the rows.

    By default it is up to 64 MB, which executor and worker each hold, several times over, for every core.
    """
    now = int(spark.conf.get(BYTES).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BYTES, BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark, label)}/table"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing still to be computed reads; other DataFrames are left alone."""
    for df in tables:
        path = df.__dict__.get("_written_at")
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes split at just the six separators of ``WORD``."""
    return text.encode().split() if text else []


class BitFilter:
    """A set of 64-bit hashes as a bitmap of fixed size, cheap to broadcast.

    It may say yes to a hash that is not in the set, never no to one that is. Its size does not depend on the data:
    the fuller it gets the fewer rows it keeps out, so it may only stand before an exact step.
    """

    LOG_BITS = 27

    def __init__(self, spark: SparkSession, hashes: DataFrame, log_bits: int = LOG_BITS):
        """``hashes`` has one long column ``h``. Blocks of the bitmap are built in tasks from distinct bit numbers."""
        mask, block = (1 << log_bits) - 1, BIT_BLOCK
        bits = hashes.select(F.col("h").bitwiseAND(mask).alias("bit")).distinct()
        groups = bits.groupBy(F.floor(F.col("bit") / block).alias("block"))

        def build(key, group):
            flags = np.zeros(block, dtype=np.uint8)
            flags[group.column("bit").to_numpy() % block] = 1
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64()),
                             "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

        parts = groups.applyInArrow(build, "block long, bits binary").collect()
        bitmap = bytearray((1 << log_bits) // 8)
        for part in parts:
            at = part["block"] * block // 8
            bitmap[at:at + block // 8] = part["bits"]
        self.mask, self._shared, self._seen = mask, spark.sparkContext.broadcast(bytes(bitmap)), None

    def __getstate__(self):
        return {"mask": self.mask, "_shared": self._shared, "_seen": None}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self._seen is None:
            self._seen = np.frombuffer(self._shared.value, dtype=np.uint8)
        at = hashes & np.uint64(self.mask)
        return (self._seen[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
