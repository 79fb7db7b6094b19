"""Event time, processing time and windows on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import epoch_ms

# Milliseconds per interval unit.
UNIT_MS = {
    "millisecond": 1,
    "second": 1_000,
    "minute": 60_000,
    "hour": 3_600_000,
    "day": 86_400_000,
}


def interval(text: str | int) -> int:
    """Milliseconds of ``"5 seconds"``; a bare number is milliseconds."""
    parts = str(text).strip().lower().split()
    unit = parts[1].removesuffix("s") if len(parts) == 2 else "millisecond"
    if len(parts) > 2 or unit not in UNIT_MS:
        raise ValueError(f"cannot read interval {text!r}")
    return int(parts[0].strip("'")) * UNIT_MS[unit]


def event_time(df: DataFrame, source: str, delay: str | int, column: str = "rowtime") -> DataFrame:
    """Adds ``column`` read from ``source`` and declares it late by at most ``delay``.

    ``source`` holds epoch milliseconds or a timestamp. The watermark only
    matters on streams and changes nothing on batch data.
    """
    kind = df.schema[source].dataType
    value = epoch_ms(F.col(source)) if isinstance(kind, T.IntegralType) else F.col(source).cast("timestamp")
    return df.withColumn(column, value).withWatermark(column, f"{interval(delay)} milliseconds")


def with_lateness(delay: str | int, lateness: str | int) -> int:
    """Watermark delay in milliseconds that also admits rows late by ``lateness``."""
    return interval(delay) + interval(lateness)


def proctime(df: DataFrame, column: str = "proctime") -> DataFrame:
    """Adds the processing time, one value per micro-batch."""
    return df.withColumn(column, F.current_timestamp())


def tumble(column: str, size: str) -> Column:
    return F.window(column, size)


def hop(column: str, size: str, slide: str) -> Column:
    return F.window(column, size, slide)


def session(column: str, gap: str) -> Column:
    return F.session_window(column, gap)


def bounds(window: str = "window", start: str = "window_start", end: str = "window_end") -> list[Column]:
    """Window bounds as zoneless timestamps."""
    return [F.col(f"{window}.start").cast("timestamp_ntz").alias(start),
            F.col(f"{window}.end").cast("timestamp_ntz").alias(end)]


def label(window: str = "window", between: str = "-;->") -> Column:
    """Window bounds as one text."""
    shape = "yyyy-MM-dd HH:mm:ss"
    return F.concat(F.date_format(f"{window}.start", shape), F.lit(between), F.date_format(f"{window}.end", shape))
