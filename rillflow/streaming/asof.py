"""As-of joins of streams: versions of the right side per key, left rows held back until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .eventtime import interval
from .leaves import BLOCK, Leaves, address, bucket, numbers
from .payload import from_bytes, packed, present, several_variables, to_bytes, unpacked

LEFT, RIGHT = 0, 1
ROWS = pa.schema([("h", pa.int64()), ("who", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("body", pa.string())])
LAST = pa.schema([("h", pa.int64()), ("place", pa.int64()), *[ROWS.field(name) for name in ("who", "at", "tie", "body")]])
CHUNKS = ["side", "slot", "number", "size", "first"]


class _AsOf(StatefulProcessor):
    """Left rows and versions of a group's keys lie in slots of event time, each in chunks of bounded size.

    A batch writes the last chunk of the slots it touches, the watermark reads those it passes, slot after slot. Versions
    of a slot that has passed shrink to the last of each key, kept in blocks by key.
    """

    def __init__(self, slot_us: int, within_us: int | None):
        self.slot, self.within = slot_us, within_us

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "number long", "rows binary")
        self.index = handle.getValueState("chunks", "chunks binary")
        self.last = Leaves(handle, "last", LAST)
        self.oldest = handle.getValueState("oldest", "at long")     # no version in ``last`` is older
        self.timer = handle.getValueState("timer", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        self._open()
        for batch in rows:
            batch = batch[batch["at"] > watermark]        # later ones may have been passed already
            for (side, slot), part in batch.groupby([batch["side"], batch["at"] // self.slot]):
                self._add(int(side), int(slot), pa.Table.from_pandas(part[ROWS.names], ROWS, preserve_index=False))
        yield from self._settle(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        self._open()
        yield from self._settle(max(timerValues.getCurrentWatermarkInMs(), 0) * 1000)

    def close(self) -> None:
        pass

    def _open(self) -> None:
        """Reads which chunks there are: per side and slot their (number, size, earliest time) as they came."""
        self.chunks, self.next, self.changed = {}, 0, False
        if self.index.exists():
            known = from_bytes(self.index.get()[0])
            for side, slot, *chunk in zip(*(known.column(name).to_pylist() for name in CHUNKS)):
                self.chunks.setdefault((side, slot), []).append(tuple(chunk))
                self.next = max(self.next, chunk[0] + 1)

    def _save(self) -> None:
        if not self.changed:
            return
        rows = [(*at, *chunk) for at, held in self.chunks.items() for chunk in held]
        if rows:
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
            self.index.update((to_bytes(pa.Table.from_arrays(columns, CHUNKS)),))
        else:
            self.index.clear()

    def _add(self, side: int, slot: int, new: pa.Table) -> None:
        """Rows of a slot go to its last chunk, or to a new one where that is full."""
        held, first, self.changed = self.chunks.setdefault((side, slot), []), int(numbers(new, "at").min()), True
        if held and held[-1][1] + len(new) <= BLOCK:
            number, _, before = held.pop()
            new, first = pa.concat_tables([from_bytes(self.rows.getValue((number,))[0]), new]), min(first, before)
        else:
            number, self.next = self.next, self.next + 1
        self.rows.updateValue((number,), (to_bytes(new.combine_chunks()),))
        held.append((number, len(new), first))

    def _read(self, side: int, slot: int) -> pa.Table:
        held = self.chunks.get((side, slot), [])
        return pa.concat_tables([ROWS.empty_table(), *[from_bytes(self.rows.getValue((n,))[0]) for n, _, _ in held]])

    def _drop(self, side: int, slot: int) -> None:
        for number, _, _ in self.chunks.pop((side, slot), []):
            self.rows.removeKey((number,))
            self.changed = True

    def _settle(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Gives the left rows up to the watermark, drops what no later one needs, and sets the timer for the next."""
        for slot in sorted({slot for _, slot in self.chunks if slot * self.slot <= watermark}):
            over = (slot + 1) * self.slot <= watermark + 1
            ready = any(first <= watermark for _, _, first in self.chunks.get((LEFT, slot), []))
            if not ready and not over:
                continue
            rights = self._read(RIGHT, slot)
            if ready:
                lefts = self._read(LEFT, slot)
                due = numbers(lefts, "at") <= watermark
                yield self._matched(lefts.filter(pa.array(due)).to_pandas(), rights)
                self._drop(LEFT, slot)
                rest = lefts.filter(pa.array(~due))
                for low in range(0, len(rest), BLOCK):
                    self._add(LEFT, slot, rest.slice(low, BLOCK))
            if over and len(rights):
                self._shrink(rights.to_pandas())
                self._drop(RIGHT, slot)
        if self.within is not None and self.oldest.exists() and self._stale() <= watermark:
            self._forget(watermark)
        self._save()
        ends = [first for (side, _), held in self.chunks.items() if side == LEFT for _, _, first in held]
        ends += [(slot + 1) * self.slot for side, slot in self.chunks if side == RIGHT]
        if self.within is not None and self.oldest.exists():
            ends.append(self._stale())
        if ends:
            self._wake(-(-min(ends) // 1000))

    def _matched(self, due: pd.DataFrame, rights: pa.Table) -> pd.DataFrame:
        known, h = [rights.select(ROWS.names)], np.unique(due["h"].to_numpy())
        self.last.open()
        for blocks in self.last.parts(self.last.find(address(h, 0))):
            held = self.last.read(blocks)
            known.insert(0, held.filter(pa.array(np.isin(numbers(held, "h"), h))).select(ROWS.names))
        known = pa.concat_tables(known).to_pandas().sort_values(["at", "tie"], kind="stable")
        found = pd.merge_asof(due[["who", "at", "body"]].sort_values("at", kind="stable"),
                              known[["who", "at", "body"]].rename(columns={"body": "found"}), on="at", by="who",
                              tolerance=self.within)
        return pd.DataFrame({"left": found["body"], "found": found["found"].astype(object).where(found["found"].notna(), None)})

    def _shrink(self, passed: pd.DataFrame) -> None:
        """Takes over the last version of each key in a slot, which is later than what it has of that key."""
        passed = passed.sort_values(["at", "tie"], kind="stable").drop_duplicates("who", keep="last").assign(place=0)
        h = passed["h"].to_numpy()
        self.last.open()
        of = self.last.find(address(h, 0))
        for blocks in self.last.parts(of):
            both = pd.concat([self.last.read(blocks).to_pandas(), passed[np.isin(of, blocks)]])
            both = both.drop_duplicates("who", keep="last")
            self.last.write(blocks, pa.Table.from_pandas(both[LAST.names], LAST, preserve_index=False))
        self.last.close()
        if self.within is not None:
            least = int(passed["at"].min())
            self.oldest.update((min(least, self.oldest.get()[0]) if self.oldest.exists() else least,))

    def _stale(self) -> int:
        """When the versions are looked through again, which is once in a slot's time at most."""
        return self.oldest.get()[0] + self.within + self.slot

    def _forget(self, watermark: int) -> None:
        """Drops versions that lie too far back for every later left row."""
        left = []
        self.last.open()
        for blocks in self.last.parts(np.arange(len(self.last.starts))):
            held = self.last.read(blocks)
            held = held.filter(pa.array(numbers(held, "at") + self.within >= watermark))
            self.last.write(blocks, held)
            if len(held):
                left.append(int(numbers(held, "at").min()))
        self.last.close()
        if left:
            self.oldest.update((min(left),))
        else:
            self.oldest.clear()

    def _wake(self, due: int) -> None:
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for is None or due < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(due)
            self.timer.update((due,))


def asof_stream(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                values: dict[str, str], tie: str | None = None, slot: str | int = "1 hour", within: str | int | None = None,
                ways: int = 1) -> DataFrame:
    """Each left row of a stream with ``values`` of the latest right row at or before it, once the watermark has passed it.

    Both sides are streams with a watermark on their time (a timestamp). A left row comes out when no earlier right row
    can arrive any more, so the result does not depend on the order of arrival. Rows later than the watermark are
    dropped, as are rows without a time; null keys match nothing. Right rows of equal time go by the whole-number column
    ``tie``, the greatest wins. ``values`` maps right columns to output names.

    State of a key: rows of the time that the watermark has not passed, in slots of ``slot``, and one right row before it.
    Keys are held in groups; a group's rows of one slot should fit a task. With ``within`` a right row that lies further
    back does not count, and keys that went silent lose their state, a slot later at most.
    ``ways`` cuts the left rows of each key into so many parts, for keys that one task can't carry; right rows are copied
    to all of them.
    """
    several_variables(left.sparkSession)
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    body = packed(left.columns)
    who = packed(keys).alias("who")
    lefts = left.where(F.col(left_time).isNotNull()).select(
        who, F.pmod(F.xxhash64(body), F.lit(ways)).cast("int").alias("part"), F.col(left_time).alias("event"),
        F.lit(LEFT).alias("side"), micros(left_time).alias("at"), F.lit(0).cast("long").alias("tie"), body.alias("body"))
    order = F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))) if tie else F.lit(0).cast("long")
    rights = right.where(present(right_time, *keys)).select(
        who, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("part"), F.col(right_time).alias("event"),
        F.lit(RIGHT).alias("side"), micros(right_time).alias("at"), order.alias("tie"), packed(list(values)).alias("body"))
    processor = _AsOf(interval(slot) * 1000, None if within is None else interval(within) * 1000)
    placed = lefts.unionByName(rights).withColumn("who", F.concat_ws(" ", "part", "who")).drop("part")
    placed = placed.withColumn("h", F.xxhash64("who")).withColumn("bucket", bucket())
    joined = placed.groupBy("bucket").transformWithStateInPandas(processor, "left string, found string", "append", "eventTime")
    one, other = unpacked("left", left.schema.fields), unpacked("found", [right.schema[name] for name in values])
    return joined.select(one.alias("l"), other.alias("r")).select(
        "l.*", *[F.col(f"r.`{name}`").alias(alias) for name, alias in values.items()])
