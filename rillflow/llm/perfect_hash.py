"""Minimal perfect hashes over sets of terms, built in shards and looked up for whole arrays of terms at once.

A shard places its terms level by level: a term that is alone at its position of a level's bitmap is placed there, the
others try the next level, which has a bitmap of its own. The rank of the set bit is the term's slot, so slots are
dense. Terms of one hash never part; all but the first of them are listed by name behind the placed ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEED, LEVELS = 42, 40       # the seed of Spark's xxhash64


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, SEED)


def _positions(hashes: np.ndarray, level: int, size) -> np.ndarray:
    x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(terms: list[bytes], hashes: np.ndarray) -> tuple[list[int], bytes, list[bytes], int]:
    """(words of 64 bits per level, the bitmaps, the terms in slot order, how many of them are placed)."""
    first = np.unique(hashes, return_index=True)[1]
    left, sizes, bitmaps, order = first, [], [], []
    while len(left) and len(sizes) < LEVELS:
        words = (2 * len(left) + 63) // 64
        at = _positions(hashes[left], len(sizes), 64 * words)
        alone = np.bincount(at, minlength=64 * words)[at] == 1
        flags = np.zeros(64 * words, dtype=np.uint8)
        flags[at[alone]] = 1
        sizes.append(words)
        bitmaps.append(np.packbits(flags, bitorder="little").tobytes())
        order.extend(left[alone][np.argsort(at[alone])].tolist())
        left = left[~alone]
    placed = len(order)
    order += sorted(set(range(len(terms))) - set(order))
    return sizes, b"".join(bitmaps), [terms[i] for i in order], placed


class PerfectHashes:
    """Shards side by side. Names (here: languages) have shards of their own; slots are dense over all of a name's."""

    def __init__(self, shards: pa.Table):
        """``shards``: columns name, shard, shards, sizes, bits, keys, placed; any order, all shards of each name."""
        self.shards = shards.sort_by([("name", "ascending"), ("shard", "ascending")]).combine_chunks()
        self._ready = False

    def __getstate__(self):
        return {"shards": self.shards, "_ready": False}

    def _load(self) -> None:
        table = self.shards
        names, counts = table.column("name").to_pylist(), table.column("shards").to_pylist()
        sizes, placed = table.column("sizes").to_pylist(), table.column("placed").to_pylist()
        keys = table.column("keys").combine_chunks() if len(table) else pa.array([], pa.list_(pa.binary()))
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        lengths = np.array([len(x) for x in keys], dtype=np.int64)
        self.keys = keys.flatten()
        self.offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.words = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype="<u8")
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        depth = max(map(len, sizes), default=0)
        self.size = np.zeros((len(sizes), depth), dtype=np.int64)
        for at, levels in enumerate(sizes):
            self.size[at, :len(levels)] = levels
        self.start = (np.cumsum(self.size.ravel()) - self.size.ravel()).reshape(self.size.shape)
        before = self.ranks[self.start[:, 0]] if depth else np.zeros(len(sizes), dtype=np.int64)
        self.shift = self.offsets[:-1] - before
        self.of: dict[str, tuple[int, int]] = {}
        self.extra: dict[tuple[str, bytes], int] = {}
        for at, name in enumerate(names):
            self.of.setdefault(name, (at, counts[at]))
            for slot in range(self.offsets[at] + placed[at], self.offsets[at + 1]):
                self.extra[name, self.keys[slot].as_py()] = int(slot)
        self._ready = True

    def slots_of(self, name: str) -> tuple[int, int]:
        """The first slot of a name, and how many it has."""
        if not self._ready:
            self._load()
        first, count = self.of.get(name, (0, 0))
        low = int(self.offsets[first]) if count else 0
        return low, int(self.offsets[first + count]) - low if count else 0

    def shard_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard row of each slot (ascending order of name and shard), and the place in its shard."""
        at = np.searchsorted(self.offsets, slots, side="right") - 1
        return at, slots - self.offsets[at]

    def lookup(self, name: str, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for terms that are not in the set: every slot found is held against its stored term."""
        if not self._ready:
            self._load()
        slots = np.full(len(hashes), -1, dtype=np.int64)
        first, count = self.of.get(name, (0, 0))
        if not count:
            return slots
        shard = first + ((hashes >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
        left = np.arange(len(hashes))
        for level in range(self.size.shape[1]):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = 64 * self.start[shard[left], level] + _positions(hashes[left], level, 64 * size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slots[left[hit]] = (self.ranks[at >> 6] + below + self.shift[shard[left]])[hit]
            left = left[~hit]
        found = np.flatnonzero(slots >= 0)
        same = pc.equal(self.keys.take(pa.array(slots[found])), terms.take(pa.array(found)))
        slots[found[~same.to_numpy(zero_copy_only=False)]] = -1
        if self.extra:
            for at in np.flatnonzero(slots < 0):
                slots[at] = self.extra.get((name, terms[int(at)].as_py()), -1)
        return slots
