"""Change streams, where a sign says whether a row comes or goes: joins of two, and the first rows per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .leaves import BLOCK, HELD, Leaves, address, bucket, gathered, numbers, summed
from .payload import packed, present, several_variables, unpacked

CHUNK = 50_000      # rows a processor gives at once


class _JoinChanges(StatefulProcessor):
    """Both sides of a group's keys as counted rows. A batch of changes dL, dR gives dL x R, L x dR and dL x dR."""

    rows = pa.schema([("h", pa.int64()), ("place", pa.int64()), ("who", pa.string()), ("body", pa.string()), ("n", pa.int64())])
    names = ["h", "place", "who", "body"]

    def init(self, handle) -> None:
        self.sides = [Leaves(handle, name, self.rows) for name in ("left", "right")]

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        both = pa.schema([*self.rows, ("side", pa.int32())])
        found = gathered(rows, both, [*self.names, "side"], ["n"])
        found = found.filter(pc.not_equal(found.column("n"), 0))
        changes = [found.filter(pc.equal(found.column("side"), side)).select(self.rows.names) for side in (0, 1)]
        # the right side as it will be meets the left side's changes, the left side as it was the right side's
        self._apply(1, changes[1])
        yield from self._pairs(changes[0], self.sides[1], ["left", "right"])
        yield from self._pairs(changes[1], self.sides[0], ["right", "left"])
        self._apply(0, changes[0])

    def _apply(self, side: int, changes: pa.Table) -> None:
        store = self.sides[side]
        store.open()
        of = store.find(address(numbers(changes, "h"), numbers(changes, "place")))
        for blocks in store.parts(of):
            new = changes.filter(pa.array(np.isin(of, blocks)))
            rows = summed(pa.concat_tables([store.read(blocks), new]), self.names, ["n"])
            store.write(blocks, rows.filter(pc.not_equal(rows.column("n"), 0)))
        store.close()

    def _pairs(self, changed: pa.Table, store: Leaves, names: list[str]) -> Iterator[pd.DataFrame]:
        """Every changed row with every standing one of its key; only ``changed``, a batch's rows, is held whole."""
        if not len(changed):
            return
        store.open()
        h = np.unique(numbers(changed, "h"))
        first, last = store.find(address(h, -(1 << 63))), store.find(address(h, (1 << 63) - 1))
        marks = np.zeros(len(store.starts) + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, last + 1, -1)
        changed = changed.take(pc.sort_indices(changed.column("who"))).combine_chunks()
        keys, begins, sizes = np.unique(pc.rank(changed.column("who"), tiebreaker="dense").to_numpy(), return_index=True,
                                        return_counts=True)
        keys = changed.column("who").take(pa.array(begins)).combine_chunks()
        for blocks in store.parts(np.flatnonzero(np.cumsum(marks)[:-1])):
            standing = store.read(blocks)
            at = pc.index_in(standing.column("who"), value_set=keys)
            standing, at = standing.filter(at.is_valid()).combine_chunks(), at.drop_null().to_numpy()
            ends = np.cumsum(sizes[at])
            for low in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                pair = np.arange(low, min(low + CHUNK, int(ends[-1])))
                theirs = np.searchsorted(ends, pair, side="right")
                mine = begins[at[theirs]] + pair - (ends - sizes[at])[theirs]
                mine, theirs = changed.take(pa.array(mine)), standing.take(pa.array(theirs))
                out = pd.DataFrame({names[0]: mine.column("body").to_pandas(), names[1]: theirs.column("body").to_pandas(),
                                    "sign": numbers(mine, "n") * numbers(theirs, "n")})
                yield out[["left", "right", "sign"]]


def join_changes(left: DataFrame, right: DataFrame, keys: Sequence[str], sign: str = "sign", ways: int = 1) -> DataFrame:
    """The changes of the inner join on ``keys`` of two change streams, with their sign (times more than one, for repeats).

    ``sign`` is 1 for a row that comes and -1 for one that goes, in any order: a row may go before it comes. Columns:
    those of the left side, those of the right side but the keys, and ``sign``; other names must differ. Null keys match
    nothing. Adding up the signs per row gives the join of what is left on both sides. State: each side's distinct rows
    with their number, in blocks. ``ways`` cuts the left rows of each key into so many parts, for keys that one task can't carry;
    right rows are copied to all of them.
    """
    several_variables(left.sparkSession)
    ours = [name for name in left.columns if name != sign]
    theirs = [name for name in right.columns if name != sign and name not in keys]
    body, who, given = packed(ours), packed(keys).alias("who"), present(*keys)
    lefts = left.where(given).select(
        who, F.pmod(F.xxhash64(body), F.lit(ways)).cast("int").alias("part"), F.lit(0).alias("side"), body.alias("body"),
        F.col(sign).cast("long").alias("n"))
    rights = right.where(given).select(
        who, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("part"), F.lit(1).alias("side"),
        (packed(theirs) if theirs else F.lit("{}")).alias("body"), F.col(sign).cast("long").alias("n"))
    placed = lefts.unionByName(rights).withColumn("who", F.concat_ws(" ", "part", "who")).drop("part").withColumns(
        {"h": F.xxhash64("who"), "place": F.xxhash64("body")}).withColumn("bucket", bucket())
    joined = placed.groupBy("bucket").transformWithStateInPandas(
        _JoinChanges(), "left string, right string, sign long", "append", "none")
    one = unpacked("left", [left.schema[name] for name in ours]).alias("l")
    other = unpacked("right", [right.schema[name] for name in theirs]).alias("r") if theirs else F.lit(None).alias("r")
    return joined.select(one, other, "sign").select("l.*", *[F.col(f"r.`{name}`") for name in theirs], F.col("sign").alias(sign))


class _TopChanges(StatefulProcessor):
    """Counted rows of a group's keys in their order; the first rows come from a key's first blocks, whatever lies behind."""

    rows = pa.schema([("h", pa.int64()), ("place", pa.int64()), ("who", pa.string()), ("part", pa.int32()), ("at", pa.int64()),
                      ("tie", pa.int64()), ("body", pa.string()), ("n", pa.int64())])
    names = ["h", "place", "who", "part", "at", "tie", "body"]

    def __init__(self, count: int, width: int, deletes: bool):
        self.count, self.width, self.deletes = count, width, deletes

    def init(self, handle) -> None:
        self.store = Leaves(handle, "blocks", self.rows)

    def close(self) -> None:
        pass

    def _given(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not self.deletes and (frame["sign"] < 0).any():
                raise ValueError("rows go: the stream needs deletes=True")
            yield frame.assign(place=frame["at"] // self.width, n=frame["sign"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = gathered(self._given(rows), self.rows, self.names, ["n"])
        self.store.open()
        of = self.store.find(address(numbers(changes, "h"), numbers(changes, "place")))
        h = np.unique(numbers(changes, "h"))
        first, last = self.store.find(address(h, -(1 << 63))), self.store.find(address(h, (1 << 63) - 1))
        # keys that share no block are worked on apart
        total = np.cumsum(np.concatenate([[0], self.store.sizes]))
        apart, part, size = np.concatenate([[True], first[1:] > last[:-1]]), np.zeros(len(h), np.int64), 0
        for at in range(len(h)):
            fresh = apart[at] and size > HELD
            part[at] = part[at - 1] + fresh if at else 0
            size = (0 if fresh else size) + min(int(total[last[at] + 1] - total[first[at]]), BLOCK)
        for number in range(int(part[-1]) + 1 if len(h) else 0):
            mine = part == number
            new = pa.array(np.isin(numbers(changes, "h"), h[mine]))
            yield from self._ranked(changes.filter(new), np.unique(of[new.to_numpy(zero_copy_only=False)]), h[mine], first[mine], last[mine])
        self.store.close()

    def _ranked(self, changes: pa.Table, blocks: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pd.DataFrame]:
        blocks = np.union1d(blocks, first)
        held = self.store.read(blocks)
        while True:
            rows = summed(pa.concat_tables([held, changes]), self.names, ["n"])
            rows = rows.filter(pc.not_equal(rows.column("n"), 0))
            if not len(more := self._missing(held, rows, blocks, h, first, last)):
                break
            blocks, held = np.union1d(blocks, more), pa.concat_tables([held, self.store.read(more)])
        before, after = self._top(held)[0], self._top(rows)[0]
        if not self.deletes:        # what can't come up any more goes
            rows = self._top(rows)[1]
        self.store.write(blocks, rows)
        both = before.merge(after, on=["who", "rank"], how="outer", suffixes=("_old", "_new"))
        both = both[both["body_old"].isna() | both["body_new"].isna() | (both["body_old"] != both["body_new"])]
        out = [pd.DataFrame({"part": both[f"part_{x}"], "rank": both["rank"], "body": both[f"body_{x}"], "sign": sign}).dropna()
               for x, sign in (("old", -1), ("new", 1))]
        out = pd.concat(out).astype({"part": "int32", "rank": "int32", "sign": "int32"})
        if len(out):
            yield out

    def _missing(self, held: pa.Table, rows: pa.Table, blocks: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The next block of each key whose first rows may lie in blocks that have not been read."""
        more = set()
        for at in np.flatnonzero(last > first):
            unread = np.setdiff1d(np.arange(first[at], last[at] + 1), blocks)
            if not len(unread):
                continue
            for table in (held, rows):
                own = table.filter(pa.array((numbers(table, "h") == h[at]) & (numbers(table, "n") > 0)))
                near = self.store.find(address(numbers(own, "h"), numbers(own, "place"))) < unread[0]
                per_key = own.filter(pa.array(near)).group_by("who").aggregate([("n", "sum")])
                # keys of one hash may lie here too: each one needs its first rows
                if len(own.column("who").unique()) > len(per_key) or not len(per_key) or pc.min(per_key.column("n_sum")).as_py() < self.count:
                    more.add(int(unread[0]))
        return np.array(sorted(more), np.int64)

    def _top(self, rows: pa.Table) -> tuple[pd.DataFrame, pa.Table]:
        """The ranking of each key, a row for each rank, and the rows that it takes."""
        rows = rows.filter(pc.greater(rows.column("n"), 0)).sort_by([(n, "ascending") for n in ("who", "at", "tie", "body")])
        n = numbers(rows, "n")
        who = pc.rank(rows.column("who").combine_chunks(), tiebreaker="dense").to_numpy() if len(rows) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        start = (ends - n)[np.searchsorted(who, who, side="left")] if len(rows) else ends
        ahead = ends - n - start
        taken = ahead < self.count
        rows, ahead, n = rows.filter(pa.array(taken)), ahead[taken], n[taken]
        times = np.minimum(n, self.count - ahead)
        out = rows.select(["who", "part", "body"]).to_pandas()
        at = np.repeat(np.arange(len(out)), times)
        rank = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + ahead[at] + 1
        return out.iloc[at].assign(rank=rank), rows


def topk_changes(changes: DataFrame, keys: Sequence[str], order: str, count: int, tie: str | None = None,
                 sign: str | None = None, descending: bool = True, width: int = 1 << 16, ways: int = 1) -> DataFrame:
    """The changes of the first ``count`` rows per key: at each rank that changes the old row goes, the new one comes.

    ``order`` is a whole-number column, largest first if ``descending``; ``tie``, another one, orders equals, smallest
    first, and then the rows' texts. Rows with a null order do not take part; null ties come first, null keys are a key.
    ``sign`` is the column that says whether a row comes (1) or goes (-1), in any order of arrival; without it rows only
    come, and no more than ``count`` of them are held per key and part. Else a key's rows are held in blocks of ``width``
    of the order; a batch reads the blocks it changes and as many of the first ones as make up ``count`` rows.

    Columns: those of ``changes`` without sign, ``part``, ``rank`` and ``sign``. Adding up the signs per row and rank gives
    the ranking as it stands. ``ways`` cuts keys into so many parts, each with a ranking of its own, which
    ``merged_ranking`` puts together when it is read.
    """
    several_variables(changes.sparkSession)
    names = [name for name in changes.columns if name != sign]
    value = F.col(order).cast("long")
    body = packed(names)
    rows = changes.where(value.isNotNull()).select(
        packed(keys).alias("who"), F.pmod(F.xxhash64(body), F.lit(ways)).cast("int").alias("part"),
        (-value if descending else value).alias("at"),
        (F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))) if tie else F.lit(0).cast("long")).alias("tie"),
        body.alias("body"), (F.col(sign).cast("long") if sign else F.lit(1).cast("long")).alias("sign"))
    rows = rows.withColumn("who", F.concat_ws(" ", "part", "who")).withColumn("h", F.xxhash64("who")).withColumn("bucket", bucket())
    out = rows.groupBy("bucket").transformWithStateInPandas(
        _TopChanges(count, width, sign is not None), "part int, rank int, body string, sign int", "append", "none")
    return out.select(unpacked("body", [changes.schema[name] for name in names]).alias("r"), "part", "rank", "sign").select(
        "r.*", "part", "rank", "sign")


def merged_ranking(log: DataFrame, keys: Sequence[str], order: str, count: int, tie: str | None = None,
                   descending: bool = True) -> DataFrame:
    """The ranking that a log of ``topk_changes`` stands for, parts of a key put together: at most ``count`` rows of each."""
    from ..operators.ordered import top_per_group

    names = [name for name in log.columns if name not in ("part", "rank", "sign")]
    stands = log.groupBy(*names, "part", "rank").agg(F.sum("sign").alias("n")).where("n > 0")
    first = [F.col(order).desc() if descending else F.col(order).asc(), *([F.col(tie)] if tie else [])]
    return top_per_group(stands.select(*names), keys, [*first, packed(names)], count).withColumnRenamed("rn", "rank")


def _remaining(kind: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How often rows are in the result, from how often they are on either side."""
    left, right = np.maximum(left, 0), np.maximum(right, 0)
    if kind == "except":
        return ((left > 0) & (right == 0)).astype(np.int64)
    if kind == "intersect":
        return ((left > 0) & (right > 0)).astype(np.int64)
    return np.maximum(left - right, 0) if kind == "except all" else np.minimum(left, right)


class _SetChanges(StatefulProcessor):
    """The counts of a group's rows."""

    rows = pa.schema([("h", pa.int64()), ("place", pa.int64()), ("who", pa.string()), ("l", pa.int64()), ("r", pa.int64())])

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        self.counts = Leaves(handle, "counts", self.rows)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["h", "place", "who"]
        changes = gathered((x.assign(place=0) for x in rows), self.rows, names, ["l", "r"])
        self.counts.open()
        of = self.counts.find(address(numbers(changes, "h"), 0))
        for blocks in self.counts.parts(of):
            new = changes.filter(pa.array(np.isin(of, blocks)))
            new = pa.table([*(new.column(n) for n in names), pa.array(np.zeros(len(new), np.int64)),
                            pa.array(np.zeros(len(new), np.int64)), new.column("l"), new.column("r")], [*names, "l", "r", "dl", "dr"])
            both = pa.concat_tables([self.counts.read(blocks), new], promote_options="default")
            both = summed(both, names, ["l", "r", "dl", "dr"])
            l, r, dl, dr = (np.nan_to_num(numbers(both, n)).astype(np.int64) for n in ("l", "r", "dl", "dr"))
            change = _remaining(self.kind, l + dl, r + dr) - _remaining(self.kind, l, r)
            stays = pa.table([*(both.column(n) for n in names), pa.array(l + dl), pa.array(r + dr)], self.rows)
            self.counts.write(blocks, stays.filter(pa.array((l + dl != 0) | (r + dr != 0))))
            if change.any():
                met = np.flatnonzero(change)
                yield pd.DataFrame({"body": both.column("who").take(pa.array(met)).to_pandas(), "sign": change[met]})
        self.counts.close()


def set_changes(left: DataFrame, right: DataFrame, kind: str, sign: str | None = None) -> DataFrame:
    """The changes of ``left`` except or intersect ``right`` over whole streams, as rows arrive in any order.

    ``kind`` is ``except``, ``except all``, ``intersect`` or ``intersect all``. Both sides have the same columns; nulls are
    equal to each other. With ``sign``, rows also go (-1). Adding up the column ``sign`` (or of that name) per row of the
    result gives how often the row is in it. State: two counts for each distinct row that stands on a side, in blocks.
    """
    if kind not in ("except", "except all", "intersect", "intersect all"):
        raise ValueError(f"no set operation {kind!r}")
    several_variables(left.sparkSession)
    names = [name for name in left.columns if name != sign]
    given = (F.col(sign) if sign else F.lit(1)).cast("long")
    none = F.lit(0).cast("long")
    sides = [side.select(packed(names).alias("who"), *[(given if at == number else none).alias(n) for at, n in enumerate("lr")])
             for number, side in enumerate((left, right))]
    placed = sides[0].unionByName(sides[1]).withColumn("h", F.xxhash64("who")).withColumn("bucket", bucket())
    out = placed.groupBy("bucket").transformWithStateInPandas(_SetChanges(kind), "body string, sign long", "append", "none")
    fields = [left.schema[name] for name in names]
    return out.select(unpacked("body", fields).alias("r"), F.col("sign").alias(sign or "sign")).select("r.*", sign or "sign")
