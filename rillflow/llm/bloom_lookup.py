"""Document fingerprints as invertible Bloom lookup sketches of paragraphs, compared by subtracting and peeling.

A paragraph's digest enters one cell of each of three tables; a cell holds the number of its digests, their sum and the
sum of their check values, all modulo powers of two. The difference of two sketches holds just what only one text has.
Cells with a single digest give it away, and taking it out of its other cells uncovers more. Where that stops before
all cells are empty, both texts are sketched again with four times the cells.

Sketches are built and peeled for many pairs of texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, query, table, texts, written

PARAGRAPH = regex.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")      # a paragraph ends with a line or a sentence
TABLES, FIRST, LARGER = 3, 4, 4     # tables of a sketch, cells of a table at first, growth after a failure
HELD = 1 << 22                      # code points of texts compared at once


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """A digest per paragraph; a paragraph that comes again has another one each time, so all of a text's digests differ."""
    found = np.array([xxhash.xxh3_64_intdigest(x) for x in PARAGRAPH.findall(text)], dtype=np.uint64)
    while True:
        order = np.argsort(found, kind="stable")
        begins = np.ones(len(found), dtype=bool)
        begins[1:] = found[order][1:] != found[order][:-1]
        if begins.all():
            return found
        again = np.arange(len(found)) - np.maximum.accumulate(np.where(begins, np.arange(len(found)), 0))
        more = order[~begins]
        found[more] = _mixed(found[more] + _mixed(again[~begins].astype(np.uint64), 0), 0)


@dataclass
class Sketches:
    """One sketch for each text of a list, with ``size`` cells a table."""

    size: int
    count: np.ndarray
    total: np.ndarray
    check: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, owner: np.ndarray, texts: int, size: int) -> Sketches:
        cells = texts * TABLES * size
        made = Sketches(size, np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64))
        made.add(keys, owner, np.ones(len(keys), dtype=np.int64))
        return made

    def add(self, keys: np.ndarray, owner: np.ndarray, times: np.ndarray) -> None:
        worth, check = times.astype(np.uint64), _mixed(keys, 1)
        for number in range(TABLES):
            # every size has positions of its own: what collides in one sketch need not in the next
            place = _mixed(keys, 2 + number + TABLES * self.size) & np.uint64(self.size - 1)
            at = (owner * TABLES + number) * self.size + place.astype(np.int64)
            np.add.at(self.count, at, times)
            np.add.at(self.total, at, worth * keys)
            np.add.at(self.check, at, worth * check)

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches(self.size, self.count - other.count, self.total - other.total, self.check - other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign (1: only in the first text) of what was recovered, and for each text if that was all."""
        found = []
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[one]
            key = sign.astype(np.uint64) * self.total[one]
            pure = _mixed(key, 1) == sign.astype(np.uint64) * self.check[one]
            owner, key, sign = one[pure] // (TABLES * self.size), key[pure], sign[pure]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
            owner, key, sign = owner[new], key[new], sign[new]
            if not len(key):
                break
            found.append((owner, key, sign))
            self.add(key, owner, -sign)
        left = (self.count != 0) | (self.total != 0) | (self.check != 0)
        whole = ~left.reshape(-1, TABLES * self.size).any(axis=1)
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return *columns, whole

    def texts(self) -> list[str]:
        """Each sketch in hexadecimal digits."""
        cells = np.zeros(len(self.count), dtype=[("n", "<u2"), ("total", "<u8"), ("check", "<u4")])
        cells["n"], cells["total"], cells["check"] = self.count & 0xFFFF, self.total, self.check & np.uint64(0xFFFFFFFF)
        raw, step = cells.tobytes(), TABLES * self.size * cells.itemsize
        return [raw[at:at + step].hex() for at in range(0, len(raw), step)]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return (np.concatenate(lists) if lists else np.zeros(0, np.uint64)), owner


def differing(first: list[np.ndarray], second: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest lists the digests that only the one and only the other holds."""
    out: list = [None] * len(first)
    left, size = np.arange(len(first)), FIRST
    while len(left):
        sketches = [Sketches.of(*_flat([lists[i] for i in left]), len(left), size) for lists in (first, second)]
        owner, key, sign, whole = (sketches[0] - sketches[1]).peel()
        order = np.argsort(owner, kind="stable")
        owner, key, sign = owner[order], key[order], sign[order]
        edges = np.searchsorted(owner, np.arange(len(left) + 1))
        for at in np.flatnonzero(whole):
            mine = slice(edges[at], edges[at + 1])
            out[left[at]] = key[mine][sign[mine] > 0], key[mine][sign[mine] < 0]
        left, size = left[~whole], size * LARGER
    return out


def likeness(first: list[np.ndarray], second: list[np.ndarray]) -> list[float]:
    """Shared paragraphs among all paragraphs of each pair, 1 for two empty texts."""
    found = []
    for own, (only, other) in zip(first, differing(first, second)):
        shared = len(own) - len(only)
        whole = shared + len(only) + len(other)
        found.append(shared / whole if whole else 1.0)
    return found


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
NAMES = [f.split()[0] for f in RESULT.split(", ")]
KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]


def compared(rows: list[tuple]) -> list[list]:
    """Columns of ``RESULT`` for rows (doc_id, text, digests, next text, next digests)."""
    ids, own, own_digests, after, after_digests = (list(c) for c in zip(*rows))
    edited = [text[:len(text) - len(text) // 2] + other[:len(text) // 2] for text, other in zip(own, after)]
    edited_digests = [digests(text) for text in edited]
    prints = [Sketches.of(*_flat(lists), len(lists), FIRST).texts() for lists in (own_digests, edited_digests)]
    return [ids, [len(text) for text in own], [hashlib.sha256(text.encode()).hexdigest() for text in edited], *prints,
            likeness(own_digests, edited_digests), likeness(own_digests, after_digests)]


def _batches(rows: Iterator[tuple], more: list) -> Batches:
    """Compared rows in batches, with ``more`` null columns (name, type) behind them."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(compared(held), KINDS)]
        return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(held), k) for _, k in more], NAMES + [n for n, _ in more])

    for row in rows:
        held.append(row)
        size += 200 + len(row[1]) + len(row[3])
        if size > HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


EDGE = [("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())]


def walk(ordered: DataFrame) -> DataFrame:
    """Rows compared with those that follow in their partition; the first (edge 0) and last (edge 1) of each come as they are."""

    def run(batches: Batches) -> Batches:
        part, ends = TaskContext.get().partitionId(), []

        def edge(number: int, doc_id, text: str) -> pa.RecordBatch:
            values = [doc_id, *[None] * (len(NAMES) - 1), part, number, text]
            kinds = KINDS + [k for _, k in EDGE]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], NAMES + [n for n, _ in EDGE])

        def pairs() -> Iterator[tuple]:
            before = None
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py() or ""
                    row = doc_id, text, digests(text)
                    if before is None:
                        ends.append(edge(0, doc_id, text))
                    else:
                        yield *before, text, row[2]
                    before = row
            if before is not None:
                ends.append(edge(1, *before[:2]))

        yield from _batches(pairs(), EDGE)
        yield from ends

    return ordered.mapInArrow(run, f"{RESULT}, part int, edge int, text string")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``RESULT`` for every document: its fingerprint, that of its edited text, and their likeness.

    Documents are in descending order of their ids, null ids last, rows of one id by a hash of their text; the last is
    followed by the first. The edited text has the last half of the code points replaced by as many from the beginning
    of the next document's text, or all it has. Likeness is the share of paragraphs two texts have in common, repeats
    counted, among all that either has. Null texts are empty; empty texts have the fingerprint of no paragraph and are
    alike. Repeated rows come out as often as they came in, followed by each other; one document is followed by itself;
    no documents give no rows. Texts of any length are taken whole, each in the memory of one task.

    Texts are shuffled once, by ranges of the order; the next document of a partition's last one comes from one row for
    each partition.
    """
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col)
    # the last column spreads copies of one row over partitions
    order = [F.col("doc_id").desc_nulls_last(), F.col("th"), F.col("row")]
    placed = rows.withColumns({"th": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = written(walk(placed), "walked")
    edges = walked.where("edge is not null").select("doc_id", "part", "edge", "text")
    parts = [r["part"] for r in edges.where("edge = 0").select("part").orderBy("part").collect()]   # one for each partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    first = edges.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    last = edges.where("edge = 1").join(follows, "part").join(first, "next").select("doc_id", "text", "next_text")

    def run(batches: Batches) -> Batches:
        rows = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        return _batches(((i, t, digests(t), n, digests(n)) for i, t, n in rows), [])

    return walked.where("edge is null").select(*NAMES).unionByName(last.mapInArrow(run, RESULT))


@query("op12_lookup_sketch")
def lookup_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
