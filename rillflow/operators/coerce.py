"""Values as a typed store takes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SchemaError, data_type

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _one(value: Column, have: T.DataType, want: T.DataType, name: str) -> Column:
    if isinstance(have, T.NullType) or have == want:
        return value.cast(want)
    if isinstance(want, T.StringType):
        return value.cast("string")
    if isinstance(want, T.LongType) and isinstance(have, MOMENTS):
        return F.unix_millis(value.cast("timestamp"))
    if isinstance(want, INTEGRAL) and isinstance(have, INTEGRAL):
        return value.cast(want)
    if isinstance(want, (T.FloatType, T.DoubleType)) and isinstance(have, (T.FloatType, T.DoubleType)):
        return value.cast(want)
    if isinstance(want, T.DecimalType) and isinstance(have, T.DecimalType):
        return value.cast(want)
    raise SchemaError(f"column {name}: cannot store {have.simpleString()} as {want.simpleString()}")


def to_store(df: DataFrame, columns: dict[str, str | T.DataType]) -> DataFrame:
    """``df`` with each column in its store type.

    Any type fits a string column, dates and timestamps become epoch
    milliseconds in a 64-bit column, nulls stay null, and pairs of unrelated
    types are refused when the plan is built.
    """
    return df.select(*[
        _one(F.col(f"`{name}`"), df.schema[name].dataType, data_type(kind), name).alias(name)
        for name, kind in columns.items()
    ])


def row_text(df: DataFrame, separator: str = ",") -> Column:
    """One text per row: values in column order, nulls as ``null``."""
    return F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns])
