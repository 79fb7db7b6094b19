"""Ordered (OVER) functions that do not put a whole key into one task.

A plain window sorts all rows of a key in one task. Here the rows of a key are
cut into buckets that follow the order, windows run per key and bucket, and
each bucket gets marker rows with what it needs from its neighbours: counts,
edge values or the last few rows. Markers come from one small row per key and
bucket and travel in the same shuffle as the data, so no join is needed.

``bucket`` must never decrease along the order, for example
``floor(order / width)`` or ``date_trunc('day', order)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, MARK = "__bucket", "__mark"
HEAD, REAL, TAIL = 0, 1, 2


def _along(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(BUCKET)


def _beside(edges: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``edges`` with the columns of ``one``, which has at most one row per key; null keys match."""
    renamed = one.withColumnsRenamed({key: f"__o_{key}" for key in keys})
    cond = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"__o_{key}")) for key in keys])
    return edges.join(renamed, cond, "left").drop(*[f"__o_{key}" for key in keys])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, ties: Sequence[str] = (),
           tiles: int | None = None) -> DataFrame:
    """Adds row_number, rank, dense_rank, percent_rank and, given ``tiles``, ntile."""
    rows = df.withColumn(BUCKET, bucket)
    value = F.struct(*[F.col(name) for name in order])
    sizes = rows.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("__n"), F.count_distinct(value).alias("__values")
    )
    before = _along(keys).rowsBetween(W.unboundedPreceding, -1)
    heads = sizes.select(
        *keys, BUCKET, F.lit(HEAD).alias(MARK),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
        F.coalesce(F.sum("__values").over(before), F.lit(0)).alias("__values_before"),
        F.sum("__n").over(W.partitionBy(*keys)).alias("__total"),
    )
    both = rows.withColumn(MARK, F.lit(REAL)).unionByName(heads, allowMissingColumns=True)
    tied = W.partitionBy(*keys, BUCKET).orderBy(MARK, *order)
    exact = W.partitionBy(*keys, BUCKET).orderBy(MARK, *order, *ties)
    whole = W.partitionBy(*keys, BUCKET).orderBy(MARK, *order, *ties).rowsBetween(W.unboundedPreceding, 0)

    def head(name: str) -> Column:
        return F.first(name, ignorenulls=True).over(whole)

    # The head marker is row 1 of its bucket, hence the -1.
    out = both.select(
        *df.columns, MARK,
        (F.row_number().over(exact) - 1 + head("__rows_before")).alias("row_number"),
        (F.rank().over(tied) - 1 + head("__rows_before")).alias("rank"),
        (F.dense_rank().over(tied) - 1 + head("__values_before")).alias("dense_rank"),
        head("__total").alias("__total"),
    ).filter(F.col(MARK) == REAL)
    out = out.withColumn(
        "percent_rank",
        F.when(F.col("__total") > 1, (F.col("rank") - 1) / (F.col("__total") - 1)).otherwise(F.lit(0.0)),
    )
    if tiles:
        out = out.withColumn("ntile", _tile(F.col("row_number"), F.col("__total"), tiles))
    return out.drop(MARK, "__total")


def _tile(row: Column, total: Column, tiles: int) -> Column:
    """Tile of a row when the first ``total % tiles`` tiles hold one row more."""
    small = F.floor(total / tiles)
    large_rows = (total % tiles) * (small + 1)
    in_large = F.floor((row - 1) / (small + 1)) + 1
    in_small = (total % tiles) + F.floor((row - 1 - large_rows) / F.greatest(small, F.lit(1))) + 1
    return F.when(row <= large_rows, in_large).otherwise(in_small).cast("int")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str,
               nth: int = 1) -> DataFrame:
    """Adds lag, lead, first_value, last_value and nth_value of ``value``; ``order`` must leave no ties."""
    rows = df.withColumn(BUCKET, bucket)
    rank = F.struct(*[F.col(name) for name in order])
    edges = rows.groupBy(*keys, BUCKET).agg(
        F.min_by(F.struct(value), rank).alias("__first"), F.max_by(F.struct(value), rank).alias("__last")
    )
    along, whole = _along(keys), W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    if nth == 1:
        edges = edges.withColumn("__nth", F.first("__first").over(whole))
    else:
        picked = top_per_group(df, keys, [F.col(name) for name in order], nth).filter(F.col("rn") == nth)
        edges = _beside(edges, picked.select(*keys, F.struct(value).alias("__nth")), keys)
    edges = edges.select(
        *keys, BUCKET,
        F.lag("__last").over(along)[value].alias("__before"),
        F.lead("__first").over(along)[value].alias("__after"),
        F.struct(
            F.first("__first").over(whole)[value].alias("first"), F.last("__last").over(whole)[value].alias("last"),
            F.col("__nth")[value].alias("nth"),
        ).alias("__ends"),
    )
    markers = edges.select(
        *keys, BUCKET, "__ends",
        F.explode(F.array(
            F.struct(F.lit(HEAD).alias(MARK), F.col("__before").alias(value)),
            F.struct(F.lit(TAIL).alias(MARK), F.col("__after").alias(value)),
        )).alias("__edge"),
    ).select(*keys, BUCKET, "__ends", "__edge.*")
    both = rows.withColumn(MARK, F.lit(REAL)).unionByName(markers, allowMissingColumns=True)
    local = W.partitionBy(*keys, BUCKET).orderBy(MARK, *order)
    ends = F.first("__ends", ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, 0))
    return (
        both.withColumns({
            "lag": F.lag(value).over(local), "lead": F.lead(value).over(local), "__ends": ends,
        })
        .filter(F.col(MARK) == REAL)
        .select(*df.columns, "lag", "lead", F.col("__ends.first").alias("first_value"),
                F.col("__ends.last").alias("last_value"), F.col("__ends.nth").alias("nth_value"))
    )


def sliding_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str,
                 preceding: int, totals: dict[str, str]) -> DataFrame:
    """Aggregates over ROWS BETWEEN ``preceding`` PRECEDING AND CURRENT ROW.

    ``totals`` maps output names to function names such as ``sum``. A bucket
    receives the last ``preceding`` rows before it. They come from the buckets
    that end among those rows, so at most twice as many are ever put together.
    """
    rows = df.withColumn(BUCKET, bucket)
    item = F.struct(*[F.col(name) for name in order], *([] if value in order else [F.col(value)]))
    from_end = W.partitionBy(*keys, BUCKET).orderBy(*[F.col(name).desc() for name in order])
    tails = (
        rows.withColumn("__back", F.row_number().over(from_end)).filter(F.col("__back") <= preceding)
        .groupBy(*keys, BUCKET).agg(F.array_sort(F.collect_list(item)).alias("__tail"))
    )
    # A bucket of more than ``preceding`` rows counts as so many: what lies before it is out of reach all the same.
    starts = F.coalesce(F.sum(F.size("__tail")).over(_along(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = W.partitionBy(*keys).orderBy("__start").rangeBetween(-max(preceding - 1, 0), 0)
    before = F.flatten(F.collect_list("__previous").over(near))
    carried = (
        tails.withColumns({"__start": starts, "__previous": F.lag("__tail").over(_along(keys))})
        .withColumn("__before", before)
        .withColumn("__before", F.when(F.size("__before") > preceding, F.slice("__before", -preceding, preceding))
                    .otherwise(F.col("__before")))
        .select(*keys, BUCKET, F.explode("__before").alias("__item"), F.lit(HEAD).alias(MARK))
        .select(*keys, BUCKET, MARK, "__item.*")
    )
    both = rows.withColumn(MARK, F.lit(REAL)).unionByName(carried, allowMissingColumns=True)
    frame = W.partitionBy(*keys, BUCKET).orderBy(MARK, *order).rowsBetween(-preceding, 0)
    return (
        both.withColumns({name: F.expr(f"{fn}(`{value}`)").over(frame) for name, fn in totals.items()})
        .filter(F.col(MARK) == REAL)
        .select(*df.columns, *totals)
    )


def sliding_range(df: DataFrame, keys: Sequence[str], order: str, value: str, preceding: int, width: int,
                  totals: dict[str, str]) -> DataFrame:
    """``sum`` and ``count`` over RANGE BETWEEN ``preceding`` PRECEDING AND CURRENT ROW of a whole-number order.

    A value enters at its position and leaves ``preceding + 1`` later, so a
    frame is a running total of what entered less what left, and its cost
    does not grow with the rows in a frame. ``width`` is that of the buckets.
    Taking back is exact for whole numbers and decimals only.
    """
    kind = df.schema[value].dataType
    if not isinstance(kind, (T.IntegralType, T.DecimalType)) or set(totals.values()) - {"sum", "count"}:
        raise ValueError("sliding_range takes sum and count of whole numbers or decimals")
    slot = F.floor(F.col("__pos") / F.lit(width)).cast("bigint")
    entered = df.select(
        "*", F.lit(REAL).alias(MARK), F.col(order).cast("bigint").alias("__pos"),
        F.coalesce(F.col(value), F.lit(0)).alias("__sum"), F.col(value).isNotNull().cast("bigint").alias("__cnt"),
    )
    left = (
        entered.filter(F.col(order).isNotNull())
        .groupBy(*keys, (F.col("__pos") + (preceding + 1)).alias("__pos"))
        .agg((-F.sum("__sum")).alias("__sum"), (-F.sum("__cnt")).alias("__cnt"))
        .withColumn(MARK, F.lit(TAIL))
    )
    moves = [part.select(*keys, slot.alias(BUCKET), "__sum", "__cnt", "__pos") for part in (entered, left)]
    before = _along(keys).rowsBetween(W.unboundedPreceding, -1)
    heads = (
        moves[0].unionByName(moves[1]).filter(F.col("__pos").isNotNull())
        .groupBy(*keys, BUCKET).agg(F.sum("__sum").alias("__sum"), F.sum("__cnt").alias("__cnt"))
        .select(*keys, BUCKET, F.sum("__sum").over(before).alias("__sum"), F.sum("__cnt").over(before).alias("__cnt"),
                F.lit(HEAD).alias(MARK), (F.col(BUCKET) * width).alias("__pos"))
    )
    both = (
        entered.withColumn(BUCKET, slot)
        .unionByName(left.withColumn(BUCKET, slot), allowMissingColumns=True)
        .unionByName(heads, allowMissingColumns=True)
    )
    sofar = W.partitionBy(*keys, BUCKET).orderBy("__pos").rangeBetween(W.unboundedPreceding, 0)
    running = both.withColumns({"__sum": F.sum("__sum").over(sofar), "__cnt": F.sum("__cnt").over(sofar)})
    results = {"sum": F.when(F.col("__cnt") > 0, F.col("__sum")), "count": F.col("__cnt")}
    return running.filter(F.col(MARK) == REAL).select(
        *df.columns, *[results[fn].alias(name) for name, fn in totals.items()])


def sliding_span(df: DataFrame, keys: Sequence[str], order: str, preceding: int, following: int, width: int,
                 totals: dict[str, Column]) -> DataFrame:
    """Any aggregates over RANGE BETWEEN ``preceding`` PRECEDING AND ``following`` FOLLOWING of a whole-number order.

    ``totals`` maps output names to aggregates, of doubles too, which cannot
    be taken back as ``sliding_range`` does. A row is copied to each bucket
    with frames it belongs to, so ``width`` should be a few times the frame,
    and a bucket of a key should fit a task. Rows without an order are each
    other's frame.
    """
    at = F.col(order).cast("bigint")
    slot = lambda x: F.floor(x / F.lit(width)).cast("bigint")
    placed = df.select(
        "*", at.alias("__pos"), slot(at).alias("__own"),
        F.explode_outer(F.sequence(slot(at - following), slot(at + preceding))).alias(BUCKET))
    frame = W.partitionBy(*keys, BUCKET).orderBy("__pos").rangeBetween(-preceding, following)
    out = placed.withColumns({name: total.over(frame) for name, total in totals.items()})
    return out.filter(F.col(BUCKET).eqNullSafe(F.col("__own"))).select(*df.columns, *totals)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """First ``count`` rows per key with their ``rn``.

    Spark keeps at most ``count`` rows per key in each task before the
    shuffle, so the size of a key does not reach the final sort.
    """
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rn).filter(F.col("rn") <= count)
