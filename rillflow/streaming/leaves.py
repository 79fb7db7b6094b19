"""State of many keys in one processor: rows in blocks of bounded size, read and written as Arrow tables.

A processor call for each key costs some milliseconds, whatever the key holds. So keys are thrown into ``BUCKETS`` groups
by their hash, and a group keeps the rows of all its keys in the order of an address of two longs, the key's hash and a
place within the key. Blocks are stretches of that order: small keys share one, a large key has many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .payload import from_bytes, to_bytes

BUCKETS = 256           # groups of keys; a checkpoint holds to their number
BLOCK = 4096            # rows of a block, if no more have one address
HELD = 100_000          # rows worked on at once
SIGN = np.uint64(1 << 63)


def bucket() -> Column:
    """The group of the key with hash ``h``."""
    return F.pmod("h", F.lit(BUCKETS)).cast("int")


def address(h: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Texts of 16 bytes in the order of (h, place)."""
    out = np.empty((len(h), 2), ">u8")
    out[:, 0] = np.asarray(h, np.int64).view(np.uint64) ^ SIGN
    out[:, 1] = np.broadcast_to(np.asarray(place, np.int64), len(h)).copy().view(np.uint64) ^ SIGN
    return out.view("S16").reshape(-1)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def summed(rows: pa.Table, names: list[str], amounts: list[str]) -> pa.Table:
    """One row for each value of ``names``, with the sums of ``amounts``."""
    out = rows.group_by(names).aggregate([(n, "sum") for n in amounts])
    return out.select([*names, *[f"{n}_sum" for n in amounts]]).rename_columns([*names, *amounts])


def gathered(frames: Iterator[pd.DataFrame], schema: pa.Schema, names: list[str], amounts: list[str]) -> pa.Table:
    """The rows of a call, summed up whenever ``HELD`` of them have come."""
    held, size = [schema.empty_table()], 0
    for frame in frames:
        held.append(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
        size += len(frame)
        if size > HELD:
            held, size = [summed(pa.concat_tables(held), names, amounts)], 0
    return summed(pa.concat_tables(held), names, amounts)


def cut(values: np.ndarray, low: int, high: int, middle: int) -> int:
    """Where in ``low`` to ``high`` the middle's value begins, or ends if it begins at ``low``."""
    begin = low + int(np.searchsorted(values[low:high], values[middle], side="left"))
    return begin if begin > low else low + int(np.searchsorted(values[low:high], values[middle], side="right"))


class Leaves:
    """The blocks of one group. ``schema`` has ``h`` and ``place``, the address, both longs, among its columns."""

    def __init__(self, handle, name: str, schema: pa.Schema):
        self.schema = schema
        self.rows = handle.getMapState(name, "number long", "rows binary")
        self.index = handle.getValueState(f"{name}_index", "blocks binary")

    def open(self) -> None:
        """Reads which blocks there are; the first one takes what lies before all others."""
        self.starts, self.ids, self.sizes = np.array([b""], "S16"), np.array([-1]), np.array([0])
        if self.index.exists():
            known = from_bytes(self.index.get()[0])
            self.starts = np.array(known.column("start").to_pylist(), "S16")
            self.ids, self.sizes = numbers(known, "id"), numbers(known, "size")
        self.next, self.cut = int(self.ids.max()) + 1, {}

    def find(self, addresses: np.ndarray) -> np.ndarray:
        """The block of each address."""
        return np.maximum(np.searchsorted(self.starts, addresses, side="right") - 1, 0)

    def parts(self, blocks: np.ndarray) -> Iterator[np.ndarray]:
        """The blocks, sorted, in parts that hold some ``HELD`` rows."""
        blocks = np.unique(blocks)
        part = np.cumsum(self.sizes[blocks] + BLOCK // 8) // HELD
        yield from np.split(blocks, np.flatnonzero(np.diff(part)) + 1) if len(blocks) else ()

    def read(self, blocks: np.ndarray) -> pa.Table:
        found = [from_bytes(self.rows.getValue((int(i),))[0]) for i in self.ids[blocks] if i >= 0]
        return pa.concat_tables([self.schema.empty_table(), *found])

    def write(self, blocks: np.ndarray, rows: pa.Table) -> None:
        """Puts ``rows`` in the place of all that the blocks held; their addresses must lie in these blocks."""
        at = address(numbers(rows, "h"), numbers(rows, "place"))
        order = np.argsort(at, kind="stable")
        rows, at = rows.select(self.schema.names).take(pa.array(order)).combine_chunks(), at[order]
        h = numbers(rows, "h")
        of = self.find(at)
        for block in blocks.tolist():
            low, high = (int(np.searchsorted(of, block, side=side)) for side in ("left", "right"))
            self.cut[block] = pieces = []
            while low < high or (block == 0 and not pieces):
                end = high
                if high - low > BLOCK:      # between keys where that is possible
                    middle = low + BLOCK // 2
                    end = cut(h, low, high, middle)
                    if end - low > BLOCK:
                        end = cut(at, low, high, middle)
                pieces.append((self.starts[block] if not pieces else at[low], self._put(block, rows.slice(low, end - low), not pieces),
                               end - low))
                low = end
            if not any(piece[1] == self.ids[block] for piece in pieces) and self.ids[block] >= 0:
                self.rows.removeKey((int(self.ids[block]),))

    def _put(self, block: int, rows: pa.Table, first: bool) -> int:
        if not len(rows):
            return -1
        number = int(self.ids[block])
        if not first or number < 0:
            number, self.next = self.next, self.next + 1
        self.rows.updateValue((number,), (to_bytes(rows),))
        return number

    def close(self) -> None:
        """Writes which blocks there are now."""
        if not self.cut:
            return
        blocks = [piece for block, old in enumerate(zip(self.starts, self.ids, self.sizes)) for piece in self.cut.get(block, [old])]
        if all(number < 0 for _, number, _ in blocks):
            if self.index.exists():
                self.index.clear()
            return
        starts, ids, sizes = zip(*blocks)
        self.index.update((to_bytes(pa.table({"start": pa.array(map(bytes, starts), pa.binary()), "id": pa.array(map(int, ids), pa.int64()),
                                              "size": pa.array(map(int, sizes), pa.int64())})),))
