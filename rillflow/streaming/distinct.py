"""Distinct counts on streams: exact ones per window, and sketches per pane that unite to windows of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eventtime import interval


def distinct_counts(stream: DataFrame, keys: Sequence[str], value: str, time: str, size: str, name: str = "n") -> DataFrame:
    """Exact number of distinct ``value`` per key and tumbling window, once the watermark on ``time`` has closed it.

    First copies of a key's values are kept by key, window and value, so a hot key is spread over its values, and the
    count that follows adds up numbers from each task. Null values do not count; windows without a value give no row.
    """
    values = stream.where(F.col(value).isNotNull()).select(*keys, F.window(time, size).alias("window"), F.col(value).alias("__v"))
    once = values.dropDuplicates([*keys, "window", "__v"])
    return once.groupBy(*keys, "window").agg(F.count("*").alias(name))


def distinct_sketches(stream: DataFrame, keys: Sequence[str], value: str, time: str, pane: str, lg_k: int = 12) -> DataFrame:
    """A sketch of the distinct ``value`` per key and pane, of at most ``2 ** lg_k`` bytes or so whatever it has seen.

    ``value`` is a whole number, a text or binary. In update mode a pane comes again whenever it has changed, and the
    newest one counts.
    """
    return stream.where(F.col(value).isNotNull()).groupBy(*keys, F.window(time, pane).alias("window")).agg(
        F.hll_sketch_agg(value, lg_k).alias("sketch"))


def united(panes: DataFrame, keys: Sequence[str], pane: str, size: str, name: str = "n") -> DataFrame:
    """Estimates per key and window of ``size``, sliding by ``pane``, from panes (keys, window_start, sketch)."""
    step, count = interval(pane), interval(size) // interval(pane)
    if interval(size) % interval(pane):
        raise ValueError(f"a window of {size} is no whole number of panes of {pane}")
    back = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__back")
    start = F.timestamp_millis(F.unix_millis("window_start") - F.col("__back") * step)
    placed = panes.withColumn("window_start", F.col("window_start").cast("timestamp")).select("*", back)
    return placed.withColumn("window_start", start).groupBy(*keys, "window_start").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
