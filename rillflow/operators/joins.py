"""Joins over time and ranges, and joins that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOT, AT, SIDE, FOUND = "__slot", "__at", "__side", "__found"


def _millis(moment: str | Column) -> Column:
    column = F.col(moment) if isinstance(moment, str) else moment
    return F.unix_millis(column.cast("timestamp"))


def _slot(millis: Column, width_ms: int) -> Column:
    return F.floor(millis / F.lit(width_ms)).cast("bigint")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              values: dict[str, str], width_ms: int, ties: Sequence[str] = ()) -> DataFrame:
    """Each left row with ``values`` of the latest right row at or before it.

    Rows meet per key and time slot, so a key that holds much of the data is
    spread over its slots. What a slot needs from earlier ones is one right
    row, found from one row per key and slot. ``values`` maps right columns to
    output names; ``ties`` order right rows of equal time.
    """
    right = right.filter(" and ".join(f"`{key}` is not null" for key in keys))
    payload = F.struct(*[F.col(name).alias(alias) for name, alias in values.items()])
    rank = F.struct(F.col(AT), *[F.col(name) for name in ties])
    rights = (
        right.withColumn(AT, F.col(right_time).cast("timestamp"))
        .withColumn(SLOT, _slot(_millis(right_time), width_ms))
        .select(*keys, SLOT, AT, rank.alias("__rank"), payload.alias(FOUND))
    )
    lefts = (
        left.withColumn(AT, F.col(left_time).cast("timestamp"))
        .withColumn(SLOT, _slot(_millis(left_time), width_ms))
        .select(*keys, SLOT, AT, F.struct(*left.columns).alias("__left"))
    )
    last = rights.groupBy(*keys, SLOT).agg(F.max_by(FOUND, "__rank").alias(FOUND))
    wanted = lefts.select(*keys, SLOT).distinct()
    earlier = W.partitionBy(*keys).orderBy(SLOT).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        last.unionByName(wanted, allowMissingColumns=True)
        .groupBy(*keys, SLOT).agg(F.first(FOUND, ignorenulls=True).alias(FOUND))
        .withColumn(FOUND, F.last(FOUND, ignorenulls=True).over(earlier))
        .filter(F.col(FOUND).isNotNull())
        .withColumn(AT, F.timestamp_millis(F.col(SLOT) * width_ms))
        .withColumn(SIDE, F.lit(0))
    )
    rows = (
        lefts.withColumn(SIDE, F.lit(2))
        .unionByName(rights.withColumn(SIDE, F.lit(1)), allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
    )
    sofar = W.partitionBy(*keys, SLOT).orderBy(AT, SIDE, "__rank").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn(FOUND, F.last(FOUND, ignorenulls=True).over(sofar))
        .filter(F.col(SIDE) == 2)
        .select("__left.*", *[F.col(f"{FOUND}.{alias}").alias(alias) for alias in values.values()])
    )


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                  within_ms: int, width_ms: int | None = None, how: str = "inner") -> DataFrame:
    """Pairs of equal ``keys`` whose right time is 0 to ``within_ms`` after the left time.

    Key columns are taken from the left; all other names must differ. One side's rows are copied to the one or
    two time slots their interval touches and the join is on key and slot, so
    a hot key is spread over time. Works on batch and, with a watermark on
    both sides, on streams, where the time condition also bounds the state.

    ``how`` is ``inner``, ``left``, ``right`` or ``full``. A side whose rows stay without partner is never the
    copied one, so each of them comes out once; on a stream when the watermark says that no partner can come any
    more. ``full`` takes two joins, as either side can stay alone: the second gives just the right rows that do.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError("interval_join is inner, left, right or full")
    if how == "full":
        paired = interval_join(left, right, keys, left_time, right_time, within_ms, width_ms, "left")
        marked = left.withColumn("__there", F.lit(True))
        alone = interval_join(marked, right, keys, left_time, right_time, within_ms, width_ms, "right")
        return paired.unionByName(alone.filter(F.col("__there").isNull()).drop("__there"))
    width_ms = width_ms or max(within_ms, 1)
    if how == "left":
        reach = F.sequence(_slot(_millis(right_time) - within_ms, width_ms), _slot(_millis(right_time), width_ms))
        left_slot, right_slot = _slot(_millis(left_time), width_ms), F.explode(reach)
    else:
        reach = F.sequence(_slot(_millis(left_time), width_ms), _slot(_millis(left_time) + within_ms, width_ms))
        left_slot, right_slot = F.explode(reach), _slot(_millis(right_time), width_ms)
    lefts = left.select("*", left_slot.alias("__ls"))
    renamed = {key: f"__r_{key}" for key in keys}
    rights = right.withColumnsRenamed(renamed).select("*", right_slot.alias("__rs"))
    cond = (F.col("__ls") == F.col("__rs")) & (F.col(right_time) >= F.col(left_time)) & (
        F.col(right_time) <= F.col(left_time) + F.expr(f"interval {within_ms} milliseconds")
    )
    for key, other in renamed.items():
        cond = cond & (F.col(key) == F.col(other))
    joined = lefts.join(rights, cond, how)
    if how == "right":
        joined = joined.withColumns({key: F.col(other) for key, other in renamed.items()})
    return joined.drop("__ls", "__rs", *renamed.values())


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.001) -> DataFrame:
    """Keys that hold at least ``share`` of the rows: never more than ``1/share`` of them.

    One pass over the key columns finds them. The most frequent ``1/share``
    keys hold every such key, so that many rows reach the driver at most.
    """
    rows = Observation()
    counts = (
        df.select(*keys).observe(rows, F.count(F.lit(1)).alias("total"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    )
    frequent = counts.orderBy(F.col("__n").desc()).limit(int(1 / share)).collect()
    least = rows.get["total"] * share
    hot = [tuple(row)[:-1] for row in frequent if row["__n"] >= least]
    return df.sparkSession.createDataFrame(hot, T.StructType([df.schema[key] for key in keys]))


def spread_join(big: DataFrame, other: DataFrame, keys: Sequence[str], ways: int = 64, share: float = 0.001,
                how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are cut into ``ways`` parts on the big side.

    Null keys, which match nothing, are cut into parts as well. Only the hot
    keys' rows of ``other`` are copied. The list of hot keys is
    broadcast: ``share`` bounds it to ``1/share`` rows. Use it where an
    aggregation on the same key follows, as adaptive skew splitting stands
    back there. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("spread_join keeps rows of the big side only: inner or left")
    keys = list(keys)
    hot = F.broadcast(hot_keys(big, keys, share).withColumn("__hot", F.lit(True)))
    # The reading task counts in, so that exact copies are spread too, and a repeated task cuts the same way.
    place = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{name}`") for name in big.columns])
    part = F.pmod(place, F.lit(ways)).cast("int")
    null = reduce(lambda a, b: a | b, [F.col(f"`{key}`").isNull() for key in keys])
    cut = big.join(hot, keys, "left").withColumn("__part", F.when(F.col("__hot") | null, part).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    copied = other.join(hot, keys, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return cut.join(copied, [*keys, "__part"], how).drop("__part")
