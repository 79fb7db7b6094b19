"""Keyed changes to a table: insert, upsert, update, delete, accumulate.

Each takes the current table and a batch of changes and gives the next table.
The batch is first brought to one row per key, with map-side combining, so
that a key holding most of the batch reaches the join as a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(keys: Sequence[str], left: str = "t", right: str = "b") -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & (F.col(f"{left}.{key}") == F.col(f"{right}.{key}"))
    return cond


def _one_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [name for name in batch.columns if name not in keys]
    if not rest:
        return batch.distinct()
    rank = F.struct(*[F.col(name) for name in order]) if len(order) > 1 else F.col(order[0])
    chosen = batch.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("__row"))
    return chosen.select(*keys, "__row.*").select(*batch.columns)


def latest_by_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``, which must leave no ties."""
    return _one_per_key(batch, keys, order, F.max_by)


def first_by_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_per_key(batch, keys, order, F.min_by)


def insert_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with new keys are added; rows whose key exists change nothing."""
    first = first_by_key(batch, keys, order).select(*target.columns)
    return target.unionByName(first.join(target.select(*keys), list(keys), "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key or are added."""
    rest = [name for name in target.columns if name not in keys]
    if not rest:
        return target.unionByName(batch.select(*target.columns)).distinct()
    last = latest_by_key(batch, keys, order).select(*keys, F.struct(*rest).alias("__new"))
    met = target.select(*keys, F.struct(*rest).alias("__old")).join(last, list(keys), "full")
    row = F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("__old"))
    # a null key equals no other, so such rows of either side stay
    return met.select(*keys, row.alias("__row")).select(*keys, "__row.*").select(*target.columns)


def update(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key; keys the table lacks are ignored."""
    last = latest_by_key(batch, keys, order).withColumn("__hit", F.lit(True))
    new = [name for name in target.columns if name in batch.columns and name not in keys]
    joined = target.alias("t").join(last.alias("b"), _same(keys), "left")
    hit = F.col("b.__hit").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"b.{name}")).otherwise(F.col(f"t.{name}")).alias(name) if name in new
        else F.col(f"t.{name}")
        for name in target.columns
    ])


def delete(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in the batch go; the batch is one row per key by then."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti")


def accumulate(target: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``values`` of the batch are added to those of the table, missing ones as 0.

    Table and batch meet in one aggregation instead of an outer join, so
    both sides combine before the shuffle. Columns outside ``values`` keep
    the table's value.
    """
    rest = [name for name in target.columns if name not in keys and name not in values]
    old = target.select(*keys, *values, *rest)
    new = batch.select(*keys, *values, *[F.lit(None).cast(target.schema[n].dataType).alias(n) for n in rest])
    summed = old.unionByName(new).groupBy(*keys).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast(target.schema[name].dataType).alias(name) for name in values],
        *[F.first(name, ignorenulls=True).alias(name) for name in rest],
    )
    return summed.select(*target.columns)


def merge_into(batch: DataFrame, table: str, keys: Sequence[str], order: Sequence[str], mode: str = "upsert") -> None:
    """Apply a batch to a catalog table that supports row-level changes; an insert takes a key's first row."""
    pick = first_by_key if mode == "insert" else latest_by_key
    last = pick(batch, keys, order).alias("b")
    target = table.split(".")[-1]
    merge = last.mergeInto(table, _same(keys, left=target))
    if mode in ("upsert", "update"):
        merge = merge.whenMatched().updateAll()
    if mode in ("upsert", "insert"):
        merge = merge.whenNotMatched().insertAll()
    if mode == "delete":
        merge = merge.whenMatched().delete()
    merge.merge()
