"""Epoch milliseconds and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ms: Column) -> Column:
    """Timestamp of an epoch-millisecond column."""
    return F.timestamp_millis(ms.cast("bigint"))


def to_epoch_ms(moment: Column) -> Column:
    """Epoch milliseconds of a timestamp, zoned or not."""
    return F.unix_millis(moment.cast("timestamp"))
