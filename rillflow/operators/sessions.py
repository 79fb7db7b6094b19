"""Sessions over bounded data."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_totals(df: DataFrame, keys: Sequence[str], time: str, gap_ms: int,
                   sums: dict[str, Column]) -> DataFrame:
    """Sessions per key: ``session_start``, ``session_end`` (last row plus gap), ``cnt`` and ``sums``.

    Rows of one gap-wide slot always share a session, so slots are totalled
    first, with map-side combining, and sessions are put together from slots.
    A key then sends at most one row per slot, however many rows it has. A row
    exactly one gap after the last one still belongs to the session.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    gap = gap_ms * 1000
    slots = (
        df.withColumn("__us", at)
        .groupBy(*keys, F.floor(F.col("__us") / F.lit(gap)).alias("__slot"))
        .agg(F.min("__us").alias("__from"), F.max("__us").alias("__to"), F.count(F.lit(1)).alias("cnt"),
             *[F.sum(value).alias(name) for name, value in sums.items()])
    )
    along = W.partitionBy(*keys).orderBy("__slot")
    starts = F.col("__from") - F.lag("__to").over(along) > gap
    numbered = slots.withColumn("__new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(
        "__session", F.sum("__new").over(along.rowsBetween(W.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(*keys, "__session")
        .agg(F.timestamp_micros(F.min("__from")).alias("session_start"),
             F.timestamp_micros(F.max("__to") + gap).alias("session_end"),
             F.sum("cnt").alias("cnt"), *[F.sum(name).alias(name) for name in sums])
        .drop("__session")
    )


def hop_totals(df: DataFrame, keys: Sequence[str], time: str, size: str, slide: str,
               sums: dict[str, Column]) -> DataFrame:
    """Sliding-window sums per key with ``window_start`` and ``window_end``.

    Rows are summed per pane first, so it is panes and not rows that are copied into
    each window they belong to. A pane is as wide as the greatest common divisor of
    ``size`` and ``slide``, so that no window cuts one.
    """
    from ..streaming.eventtime import interval

    pane = f"{gcd(interval(size), interval(slide))} milliseconds"
    panes = df.withColumn("__at", F.col(time).cast("timestamp")).groupBy(*keys, F.window("__at", pane)).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()])
    placed = panes.withColumn("__at", F.col("window.start")).drop("window")
    return placed.groupBy(*keys, F.window("__at", size, slide)).agg(
        *[F.sum(name).alias(name) for name in sums]
    ).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *sums)
