"""Aggregations beyond the built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_set(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sorted set of ``value`` per key, a null kept as one (last) element.

    Repeats are removed by a combined aggregation first, so only one copy of
    each value per key is ever gathered.
    """
    pairs = df.select(*keys, F.col(value).alias("__v")).distinct()
    gathered = pairs.groupBy(*keys).agg(
        F.array_sort(F.collect_list("__v")).alias("__known"),
        F.max(F.col("__v").isNull()).alias("__has_null"),
    )
    nothing = F.array(F.lit(None).cast(df.schema[value].dataType))
    return gathered.select(
        *keys, F.when(F.col("__has_null"), F.concat("__known", nothing)).otherwise(F.col("__known")).alias(name)
    )


def grouped_sets(df: DataFrame, by: Sequence[str], sums: dict[str, Column], kind: str = "cube",
                 sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """``cube``, ``rollup`` or explicit grouping sets of summable measures.

    Measures are summed at the finest grain first. Grouping sets copy each
    row once per set, and this way they copy groups and not input rows.
    """
    fine = df.groupBy(*by).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    totals = [F.sum(name).alias(name) for name in sums]
    if kind == "cube":
        return fine.cube(*by).agg(*totals)
    if kind == "rollup":
        return fine.rollup(*by).agg(*totals)
    chosen = [[F.col(name) for name in group] for group in sets]
    return fine.groupingSets(chosen, *[F.col(name) for name in by]).agg(*totals)


def net_changes(changes: DataFrame, keys: Sequence[str], sign: str, sums: dict[str, str],
                gone: str | None = None) -> DataFrame:
    """Aggregates of a change stream, where ``sign`` -1 takes a row back.

    Groups whose rows were all taken back are left out. A stream in update
    mode has to say that they are: with ``gone`` they stay, marked by that
    column, for a changelog sink that knows it as ``deleted``.
    """
    signed = changes.groupBy(*keys).agg(
        F.sum(F.col(sign)).alias("__rows"),
        *[F.sum(F.col(sign) * F.col(value)).alias(name) for name, value in sums.items()],
    )
    rows = signed.select(*keys, F.col("__rows").alias("cnt"), *sums)
    return rows.withColumn(gone, F.col("cnt") <= 0) if gone else rows.filter("cnt > 0")


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row of both inputs once, with the inputs that have it."""
    tagged = left.select("*", F.lit(True).alias("__l"), F.lit(False).alias("__r")).union(
        right.select("*", F.lit(False), F.lit(True)))
    return tagged.groupBy(*left.columns).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))


def intersect_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows in both inputs, as one combined aggregation instead of a join."""
    return _sides(left, right).filter(F.col("__l") & F.col("__r")).select(*left.columns)


def except_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return _sides(left, right).filter(F.col("__l") & ~F.col("__r")).select(*left.columns)
