"""What keyed processors hold: rows of a caller as texts, and small tables as bytes of a state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "ignoreNullFields": "false"}


def packed(names: Sequence[str]) -> Column:
    """The columns as one text, which a Python worker can hold without converting their types; nulls are kept."""
    return F.to_json(F.struct(*[F.col(f"`{name}`") for name in names]), TEXT)


def unpacked(text: str, fields: list[T.StructField]) -> Column:
    """The struct of columns that ``packed`` wrote; null for null."""
    return F.from_json(F.col(text), T.StructType(fields), TEXT)


def present(*names: str) -> Column:
    """None of the columns is null."""
    return reduce(Column.__and__, [F.col(f"`{name}`").isNotNull() for name in names])


def to_bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def from_bytes(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def several_variables(spark: SparkSession) -> None:
    """Processors with several variables and timers need the RocksDB store; sessions of ``build_session`` have it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
