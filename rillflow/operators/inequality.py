"""Joins on inequalities alone: sorted blocks with their bounds, and pairs of blocks instead of pairs of rows."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

TESTS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
PAIRS = 1 << 20         # pairs of rows compared at once
GIVEN = 1 << 16         # pairs given at once
DENSE = 64              # ranges of a cell from which on they are joined in packs
PACKED = 128            # points or ranges of a pack
DEALT = 1 << 16         # points of a task that joins packs
PAIRED, COUNTED = 2000, 1 << 16     # rows of a block for pairs and for counts


def _ordered(values: np.ndarray) -> np.ndarray:
    """Floats as whole numbers of the same order, with NaN above all others and equal to itself, as Spark has it."""
    if values.dtype.kind != "f":
        return values
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return np.where(np.isnan(values), np.iinfo(np.int64).max, bits)


def _blocks(df: DataFrame, columns: Sequence[str], block_rows: int) -> tuple[DataFrame, list[str]]:
    """Rows without null in ``columns``, in blocks that follow the first of them, as a table (row, c0, c1, block)."""
    spark, names = df.sparkSession, [f"c{i}" for i in range(len(columns))]
    rows = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(n) for c, n in zip(columns, names)])
    rows = rows.where(" and ".join(f"{n} is not null" for n in names))     # dropna would drop NaN too
    count = max(1, math.ceil(rows.count() / block_rows))
    # the last column cuts equal values into blocks too
    placed = rows.repartitionByRange(count, *names, F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id())
    path = f"{scratch(spark, 'blocks')}/table"
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path), names


def _bounds(blocks: DataFrame, names: Sequence[str]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Block numbers and, for each column, their least and greatest values: one row for each block."""
    rows = blocks.groupBy("block").agg(*[f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)]).collect()
    ends = [tuple(_ordered(np.array([r[f"{n}_{f}"] for r in rows])) for f in ("min", "max")) for n in names]
    return [r["block"] for r in rows], ends


def _places(values: np.ndarray, right: np.ndarray, falling: bool, rights_first: bool) -> np.ndarray:
    """Whole numbers in the order of ``values``, and one side before the other among equals."""
    codes = np.unique(_ordered(values), return_inverse=True)[1].reshape(-1).astype(np.int64)
    return 2 * (codes.max(initial=0) - codes if falling else codes) + (right != rights_first)


def _beyond(places: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row that is not ``right`` the right ones before it at greater places, bit by bit of the places."""
    found, order = np.zeros(len(places), np.int64), np.arange(len(places))
    for bit in range(int(places.max(initial=0)).bit_length()):
        group = places >> (bit + 1)
        order = np.argsort(group, kind="stable")
        group, upper, theirs = group[order], (places[order] >> bit) & 1 == 1, right[order]
        seen = np.concatenate([[0], np.cumsum(upper & theirs)])
        first = np.searchsorted(group, group, side="left")
        lower = ~upper & ~theirs
        found[order[lower]] += (seen[:-1] - seen[first])[lower]
    return found


def _counts(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]], block_rows: int,
            name: str) -> DataFrame:
    """Rows of ``left`` with the number of their partners, from sorted blocks along either condition.

    A partner lies beyond a row along the first condition and before it along the second. Blocks of the first (slabs) and
    of the second (strips) cut all rows into cells, so partners are in a slab beyond and a strip before, which is a sum
    over cells, in the row's own strip and a slab beyond, or in its own slab.
    """
    spark = left.sparkSession
    (mine, test, other), (also, second, there) = conditions if len(conditions) == 2 else (conditions[0], (None, ">", None))
    value = lambda column, plain: F.col(f"`{column}`") if column else F.lit(plain)
    lefts = left.select(F.struct(*left.columns).alias("row"), value(mine, 0).alias("x"), value(also, 1).alias("y"),
                        F.lit(False).alias("right"))
    rights = right.select(F.lit(None).cast(lefts.schema["row"].dataType).alias("row"), value(other, 0).alias("x"),
                          value(there, 0).alias("y"), F.lit(True).alias("right"))
    rows = lefts.unionByName(rights).where("x is not null and y is not null")     # dropna would drop NaN too
    count = max(1, math.ceil(rows.count() / block_rows))
    # among equals a right row comes first where it must not be beyond along x, and where it is before along y
    falling = test in (">", ">="), second in ("<", "<=")
    rights_first = test in ("<", ">"), second in ("<=", ">=")

    def blocks(rows: DataFrame, axis: int, block: str) -> DataFrame:
        at = F.col("xy"[axis])
        side = F.when(F.col("right"), int(not rights_first[axis])).otherwise(int(rights_first[axis]))
        # the last column cuts equal values into blocks too
        placed = rows.repartitionByRange(count, at.desc() if falling[axis] else at.asc(), side, F.monotonically_increasing_id())
        return placed.withColumn(block, F.spark_partition_id())

    def counted(rows: DataFrame, place: Callable[[pa.Table, np.ndarray], np.ndarray]) -> DataFrame:
        """Adds the partners within each task's rows, ``place`` telling who is beyond whom."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            if not batches:
                return
            held = pa.Table.from_batches(batches)
            right = held.column("right").to_numpy()
            order = np.argsort(_places(held.column("y").to_numpy(), right, falling[1], rights_first[1]), kind="stable")
            found = np.zeros(len(held), np.int64)
            found[order] = _beyond(place(held, right)[order], right[order])
            at = held.schema.get_field_index("n")
            yield from held.set_column(at, held.schema.field(at), pa.array(held.column("n").to_numpy() + found)).to_batches()

        return rows.mapInArrow(run, rows.schema)

    def stored(rows: DataFrame, label: str) -> DataFrame:
        path = f"{scratch(spark, label)}/table"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    rows = blocks(rows.withColumn("n", F.lit(0).cast("long")), 0, "slab")
    slabs = stored(counted(rows, lambda held, right: _places(held.column("x").to_numpy(), right, falling[0], rights_first[0])),
                   "slabs")
    strips = stored(counted(blocks(slabs, 1, "strip"), lambda held, right: held.column("slab").to_numpy().astype(np.int64)),
                    "strips")

    cell = F.col("strip").cast("long") * count + F.col("slab")
    sizes = strips.where("right").groupBy(cell.alias("cell")).agg(F.count("*").alias("size"))
    grid = spark.range(count * count).select(F.col("id").alias("cell"), F.expr(f"id div {count}").alias("s"),
                                             (F.col("id") % count).alias("b")).join(sizes, "cell", "left")
    before = F.sum(F.coalesce("size", F.lit(0))).over(Window.partitionBy("b").orderBy("s").rowsBetween(
        Window.unboundedPreceding, -1))
    grid = grid.withColumn("before", F.coalesce(before, F.lit(0)))
    beyond = F.sum("before").over(Window.partitionBy("s").orderBy("b").rowsBetween(1, Window.unboundedFollowing))
    grid = grid.select("cell", F.coalesce(beyond, F.lit(0)).alias("far")).where("far > 0")
    ours = strips.where("not right").withColumn("cell", cell).join(grid, "cell", "left")
    ours = ours.select("row", (F.col("n") + F.coalesce("far", F.lit(0))).alias(name)).where(F.col(name) > 0)
    return ours.select("row.*", name)


def inequality_join(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]],
                    block_rows: int | None = None, counted: str | None = None) -> DataFrame:
    """Pairs of rows for which all ``conditions`` (left column, one of < <= > >=, right column) hold: one or two of them.

    Both sides are sorted into blocks along the first condition. A pair of blocks whose bounds rule out every pair of
    rows is not formed; the others meet in one task each, which holds two blocks and compares sorted stretches of them.
    So a task's memory does not depend on the data, and the work is that of the blocks whose bounds overlap. The bounds,
    a row for each block, pass through the driver. The columns of a condition must have the same type, all column names
    must differ. Null matches nothing, NaN is above all numbers. Repeated rows pair each time.

    With ``counted``, each left row that has a partner comes once, with the number of its partners in a column of that
    name. Pairs are counted where they would be formed, so the work grows with the rows and not with the pairs.
    ``block_rows`` is the rows of a block, by default 2,000 for pairs and 65,536 for counts.
    """
    if not 1 <= len(conditions) <= 2 or any(test not in TESTS for _, test, _ in conditions):
        raise ValueError("inequality_join takes one or two conditions of <, <=, > or >=")
    for mine, _, other in conditions:
        if left.schema[mine].dataType != right.schema[other].dataType:
            raise ValueError(f"{mine} and {other} differ in type")
    if counted:
        return _counts(left, right, conditions, block_rows or COUNTED, counted)
    spark, tests, block_rows = left.sparkSession, [TESTS[test] for _, test, _ in conditions], block_rows or PAIRED
    lefts, names = _blocks(left, [c[0] for c in conditions], block_rows)
    rights, _ = _blocks(right, [c[2] for c in conditions], block_rows)
    (ours, our_ends), (theirs, their_ends) = _bounds(lefts, names), _bounds(rights, names)

    met = np.ones((len(ours), len(theirs)), dtype=bool)
    for test, (low, high), (other_low, other_high) in zip(tests, our_ends, their_ends):
        rising = test in (operator.lt, operator.le)
        met &= test(*np.broadcast_arrays((low if rising else high)[:, None], (other_high if rising else other_low)[None, :])) \
            if len(ours) and len(theirs) else False
    partners = [(block, [theirs[j] for j in np.flatnonzero(row)]) for block, row in zip(ours, met)]
    back = [(block, [ours[i] for i in np.flatnonzero(column)]) for block, column in zip(theirs, met.T)]

    def copied(blocks: DataFrame, partners: list, mine: str, other: str, side: str) -> DataFrame:
        listed = spark.createDataFrame(partners, "block int, partners array<int>")
        rows = blocks.join(listed, "block").withColumn("partner", F.explode("partners"))
        return rows.select(F.col("block").alias(mine), F.col("partner").alias(other), F.col("row").alias(side), *names)

    both = copied(lefts, partners, "lb", "rb", "l").unionByName(copied(rights, back, "rb", "lb", "r"), allowMissingColumns=True)
    rising = tests[0] in (operator.lt, operator.le)
    strict = tests[0] in (operator.lt, operator.gt)

    def match(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        sides = []
        for name in ("l", "r"):
            own = rows.filter(rows.column(name).is_valid())
            values = [_ordered(own.column(n).to_numpy()) for n in names]
            order = np.argsort(values[0], kind="stable")
            sides.append((own.column(name).combine_chunks(), order, [v[order] for v in values]))
        (left_rows, left_order, mine), (right_rows, right_order, other) = sides
        step = max(1, PAIRS // max(1, len(right_order)))
        for at in range(0, len(left_order), step):
            chunk = [v[at:at + step] for v in mine]
            # sorted sides: what can't hold for this stretch's least demanding row holds for none of it
            if rising:
                low, high = np.searchsorted(other[0], chunk[0][0], side="right" if strict else "left"), len(right_order)
            else:
                low, high = 0, np.searchsorted(other[0], chunk[0][-1], side="left" if strict else "right")
            hold = np.ones((len(chunk[0]), high - low), dtype=bool)
            for test, value, partner in zip(tests, chunk, other):
                hold &= test(value[:, None], partner[None, low:high])
            i, j = np.nonzero(hold)
            for part in range(0, len(i), GIVEN):
                some = slice(part, part + GIVEN)
                columns = [left_rows.take(pa.array(left_order[i[some] + at])), right_rows.take(pa.array(right_order[j[some] + low]))]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, ["l", "r"])

    schema = f"l {lefts.schema['row'].dataType.simpleString()}, r {rights.schema['row'].dataType.simpleString()}"
    return both.groupBy("lb", "rb").applyInArrow(match, schema).select("l.*", "r.*")


def _clipped(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def _cell(column: Column, start: float, end: float, size: Column) -> Column:
    return F.floor((_clipped(column, start, end) - start) / size).cast("long")


def placed_ranges(ranges: DataFrame, low: str, high: str, width: float | None = None) -> tuple[DataFrame, dict[int, int], float, float]:
    """The ranges in their cells (__level, __cell), the most of them in a cell by level, and the least and greatest finite end."""
    real = ranges.where(F.col(low) < F.col(high))
    ends = [F.col(c).cast("double") for c in (low, high)]
    finite = [F.when(F.abs(e) < F.lit(math.inf), e) for e in ends]
    own = F.ceil(F.log2(finite[1] - finite[0])).cast("int")         # null for infinite ones
    start, end = real.agg(F.min(F.least(*finite)), F.max(F.greatest(*finite))).first()
    start, end = (0.0, 0.0) if start is None else (start, end)
    top = math.ceil(math.log2((end - start) / 64)) if end > start else 0
    bottom = min(top, max(top - 46, math.ceil(math.log2(width))) if width else top - 46)
    level = F.least(F.lit(top), F.greatest(F.lit(bottom), F.coalesce(own, F.lit(top))))
    size = F.pow(F.lit(2.0), level)
    cells = F.sequence(*[_cell(e, start, end, size) for e in ends])
    placed = real.withColumns({"__level": level, "__cell": F.explode(cells)})
    most = placed.groupBy("__level", "__cell").count().groupBy("__level").agg(F.max("count")).collect()
    return placed, dict(sorted(map(tuple, most))), start, end


def _looked(points: DataFrame, x: Column, levels: Sequence[int], start: float, end: float) -> DataFrame:
    """Points with their cell on each of the ``levels`` (__level, __cell)."""
    looks = [F.struct(F.lit(n).alias("__level"), _cell(x, start, end, F.lit(2.0 ** n)).alias("__cell")) for n in levels]
    if len(levels) > 1:
        looks = [F.explode(F.array(*looks))]
    look = looks[0] if looks else F.struct(F.lit(0).alias("__level"), F.lit(0).cast("long").alias("__cell"))
    return points.withColumn("__look", look).select(*points.columns, "__look.*")


def _packs(rows: DataFrame, columns: Sequence[str], least: Column, greatest: Column, name: str, dealt: int | None = None) -> DataFrame:
    """Rows that follow each other by ``least`` in a cell and task, as arrays: (__level, __cell, ``name``, and its ends as doubles).

    Tasks are those of ``rows``, or stretches of about ``dealt`` rows.
    """
    order = ["__level", "__cell", "least"]
    flat = rows.select(*order[:2], least.alias("least"), greatest.alias("greatest"), F.struct(*columns).alias("row"))
    if dealt:
        # the last column cuts equal values into tasks too
        flat = flat.repartitionByRange(max(1, math.ceil(rows.count() / dealt)), *order, F.monotonically_increasing_id())
    flat = flat.sortWithinPartitions(*order)
    schema = T.StructType([flat.schema["__level"], flat.schema["__cell"], T.StructField(f"{name}_least", T.DoubleType()),
                           T.StructField(f"{name}_greatest", T.DoubleType()), T.StructField(name, T.ArrayType(flat.schema["row"].dataType))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            level, cell, low, high = (batch.column(i).to_numpy() for i in range(4))
            at = np.arange(len(batch))
            first = np.r_[True, (level[1:] != level[:-1]) | (cell[1:] != cell[:-1])]
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % PACKED == 0)
            packs = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(batch)], pa.int32()), batch.column(4))
            ends = [level[starts], cell[starts], low[starts], np.maximum.reduceat(high, starts)]     # NaN is the greatest here too
            yield pa.RecordBatch.from_arrays([*map(pa.array, ends), packs], names)

    return flat.mapInArrow(run, schema)


def _pairs_of_packs(looked: DataFrame, placed: DataFrame, points: Sequence[str], ranges: Sequence[str], x: Column, value: str,
                    low: str, high: str) -> DataFrame:
    """Pairs in the order pack of points, range, point: each range with a run of points, the next with mostly the same run.

    The pairs grow with the square of the rows, and files keep such runs in a tenth of the bytes that pairs in the
    order of points take. A task holds two packs and the list of those that one of points meets.
    """
    ends = [F.col(c).cast("double") for c in (low, high)]
    ours = _packs(looked.where(x.isNotNull()), points, x, x, "__points", DEALT)
    theirs = _packs(placed, ranges, *ends, "__ranges")
    # as doubles, values that differ may be equal: so <= and >=
    meet = (F.col("__ranges_least") <= F.col("__points_greatest")) & (F.col("__ranges_greatest") >= F.col("__points_least"))
    near = lambda r: (r[low].cast("double") <= F.col("__points_greatest")) & (r[high].cast("double") >= F.col("__points_least"))
    packs = ours.join(theirs, ["__level", "__cell"]).where(meet)
    # filter() has no generated code, so Spark gives the ranges one by one and not all pairs of a pack of points at once
    runs = packs.select("__points", F.explode(F.filter("__ranges", near)).alias("__range"))
    pairs = runs.select("__range", F.explode("__points").alias("__point"))
    hit = (F.col("__point")[value] >= F.col("__range")[low]) & (F.col("__point")[value] < F.col("__range")[high])
    return pairs.where(hit).select("__point.*", "__range.*")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Pairs with ``low <= value < high``, found in cells of the range's own size.

    Each range lies on the level whose cells, powers of two, are as long as it, and so in two or three of them; a point
    looks once on each level that has ranges. Ranges longer than a 64th of all lie in at most 66 cells of that size, so
    neither long nor short ones are copied often and no task gets all points. Cells of ``width``, or of 2 ** -46 of the
    longest ones if that is not given, are the smallest: there are less than 50 levels. Infinite ends are allowed, null
    matches nothing, NaN is above all numbers. The ranges are a table; points may be a stream.

    On levels where a cell has 64 ranges or more, points of a table and ranges are joined in packs, and the pairs come
    in an order that takes few bytes in files.
    """
    placed, levels, start, end = placed_ranges(ranges, low, high, width)
    x = F.col(value).cast("double")
    dense = [n for n, most in levels.items() if most >= DENSE and not points.isStreaming]
    other = [n for n in levels if n not in dense]
    parts = []
    if other or not dense:
        theirs = placed.where(F.col("__level").isin(other)) if dense else placed
        hit = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
        looked = _looked(points, x, other, start, end)
        parts.append(looked.join(theirs, ["__level", "__cell"]).where(hit).drop("__level", "__cell"))
    if dense:
        theirs = placed.where(F.col("__level").isin(dense)) if other else placed
        parts.append(_pairs_of_packs(_looked(points, x, dense, start, end), theirs, points.columns, ranges.columns, x, value, low, high))
    return reduce(DataFrame.union, parts)
