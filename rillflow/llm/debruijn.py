"""Repeated passages by de Bruijn compaction: every word that a repeated window covers is found, the first stays.

Each window of ``window`` words is an edge of the de Bruijn graph. Shipping every edge would cost more than the texts,
so paths are compacted where they are read: each edge belongs to the least (by hash) of its ``anchor``-word grams, and
the successive edges that share one anchor form one path, about eight edges long. Equal edges always fall under equal
anchors. Then, by Spark aggregations and joins:

1. anchors seen only once drop out (exactly counted; a bitmap of fixed size spares the rest the trip);
2. equal paths meet, and the first occurrence of each is found. An anchor with a single path is nonbranching: all
   edges of its later occurrences are repeats, all of its first one are not;
3. where an anchor branches into several paths, their first occurrences are opened into edges, and the first
   occurrence of each edge is found.

The marks go back to the documents by source coordinates, where each is verified against the text that stands there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, BitFilter, query, table, texts, words_of, written

WINDOW, ANCHOR = 20, 6
NO_ID = -(1 << 63)              # stands for a null id, so that it comes first
FACTOR = 0x9E3779B97F4A7C15     # odd, so it has an inverse modulo 2^64
INVERSE = pow(FACTOR, -1, 1 << 64)
PLACE = (1 << 20) - 1           # low bits of a gram's hash that make way for its place


class Powers:
    """Powers of ``FACTOR`` and of its inverse, as many as the longest text so far has words."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, x, dtype=np.uint64)])
                                  for x in (np.uint64(FACTOR), np.uint64(INVERSE)))
        return self.up[:n], self.down[:n]


class Spans:
    """Hashes of any span of a text's words, from one running sum."""

    powers = Powers()

    def __init__(self, words: list[bytes]):
        n = len(words)
        up, self.down = self.powers(n + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xCA5A826395121157)
        return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def paths(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
    """(spans, starts, sizes, anchors) of the paths of a text: each covers ``sizes`` windows from ``starts`` on."""
    edges = len(words) - window + 1
    if edges < 1:
        return None
    spans = Spans(words)
    grams = spans(np.arange(len(words) - anchor + 1), anchor)
    least = sliding_min((grams & ~np.uint64(PLACE)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(PLACE)),
                        window - anchor + 1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    sizes = np.diff(np.r_[starts, edges])
    places = starts + (((least[starts] & np.uint64(PLACE)).astype(np.int64) - starts) & PLACE)
    return spans, starts, sizes, grams[places]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(h, n): anchors and how often each is met, added up inside a batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [p[3] for p in (paths(words_of(x.as_py())) for x in batch.column(0)) if p]
            if found:
                anchors, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(anchors), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long")


PATH = "a long, s long, n int, doc long, th long, start int"


def path_rows(docs: DataFrame, wanted: BitFilter, with_edges: bool) -> DataFrame:
    """Occurrences of paths under the anchors ``wanted``: key (a, s, n), place (doc, th, start), hashes of the edges."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, edges = [], []
            for i, text in enumerate(batch.column(2)):
                found = paths(words_of(text.as_py()))
                if not found:
                    continue
                spans, starts, sizes, anchors = found
                keep = wanted(anchors)
                if not keep.any():
                    continue
                starts, sizes, anchors = starts[keep], sizes[keep], anchors[keep]
                here = np.full(len(starts), i)
                parts.append((anchors, spans(starts, sizes + (WINDOW - 1)), sizes, keys[here], hashes[here], starts))
                if with_edges:
                    total = int(sizes.sum())
                    first = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
                    edges.append(spans(first + np.arange(total), WINDOW))
            if not parts:
                continue
            a, s, n, doc, th, start = (np.concatenate(x) for x in zip(*parts))
            columns = [signed(a), signed(s), pa.array(n.astype(np.int32)), pa.array(doc), pa.array(th),
                       pa.array(start.astype(np.int32))]
            if with_edges:
                ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, signed(np.concatenate(edges))))
            whole = pa.RecordBatch.from_arrays(columns, ["a", "s", "n", "doc", "th", "start", "edges"][:len(columns)])
            for at in range(0, len(whole), 50_000):
                yield whole.slice(at, 50_000)

    return docs.select("doc", "th", "text").mapInArrow(run, PATH + (", edges array<long>" if with_edges else ""))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, doc, th): the text's hash tells rows apart that share an id, null ids among them."""
    return texts(docs, id_col, text_col).withColumns(
        {"doc": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, marks): for each document the runs of windows, (start, n, key), that also start earlier.

    ``docs`` comes from ``placed``. ``key`` is the hash of the run's words.
    """
    spark, place = docs.sparkSession, F.struct("doc", "th", "start")
    repeated = anchor_counts(docs).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    found = written(path_rows(docs, BitFilter(spark, repeated), False), "paths")
    first = found.groupBy("a", "s", "n").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    first = written(first, "first")
    later = found.join(first.where("c > 1").select("a", "s", "n", "first"), ["a", "s", "n"]).where(
        place != F.col("first")).select("doc", "th", "start", "n", F.col("s").alias("key"))

    branching = written(first.groupBy("a").agg(F.count("*").alias("paths")).where("paths > 1").select("a"), "branching")
    opened = path_rows(docs, BitFilter(spark, branching.select(F.col("a").alias("h"))), True)
    firsts = first.join(branching, "a", "left_semi").select("a", "s", "n", "first")
    opened = opened.join(firsts, ["a", "s", "n"]).where(place == F.col("first"))
    edges = opened.select("a", "doc", "th", F.col("start").alias("from"), F.posexplode("edges").alias("i", "key"))
    edges = written(edges.select("a", "key", "doc", "th", (F.col("from") + F.col("i")).alias("start")), "edges")
    known = edges.groupBy("a", "key").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = edges.join(known, ["a", "key"]).where(place != F.col("first")).select(
        "doc", "th", "start", F.lit(1).alias("n"), "key")
    return later.unionByName(again).groupBy("doc", "th").agg(
        F.collect_list(F.struct("start", "n", "key")).alias("marks"))


def covered(words: list[bytes], marks: list[dict] | None) -> np.ndarray:
    """Which words lie in a marked window; a mark whose words don't stand at its place counts for nothing."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    if marks:
        start, n = (np.array([m[k] for m in marks], dtype=np.int64) for k in ("start", "n"))
        key = np.array([m["key"] for m in marks], dtype=np.int64).view(np.uint64)
        inside = start + n + WINDOW - 1 <= len(words)
        start, n, key = start[inside], n[inside], key[inside]
        right = Spans(words)(start, n + (WINDOW - 1)) == key
        np.add.at(change, start[right], 1)
        np.add.at(change, (start + n + WINDOW - 1)[right], -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(text: str | None, marks) -> str | None:
    """The text without the covered words; white space stays where it was, runs of it around a gap become one space."""
    words = words_of(text)
    gone = covered(words, marks)
    if not gone.any():
        return text
    data, out, at, gap = text.encode(), [], 0, False
    for word, drop in zip(words, gone.tolist()):
        start = data.index(word, at)
        if drop:
            gap = True
        else:
            out.append(b" " if gap and out else b"" if gap else data[at:start])
            out.append(word)
            gap = False
        at = start + len(word)
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated passages removed from ``text``, columns and rows otherwise as before.

    A document all of whose words are removed keeps its row with an empty text. Null texts stay null.
    """
    marks = repeated_spans(placed(docs)).select("doc", "th", "marks")
    cut = F.udf(lambda text, marks: without_repeats(text, marks), "string")
    here = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
                       .alias("doc"), F.xxhash64(docs["text"]).alias("th"))
    met = here.join(marks, ["doc", "th"], "left")
    text = F.when(F.col("marks").isNull(), F.col("row.text")).otherwise(cut("row.text", "marks")).alias("text")
    return met.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, words removed, and the hash of the kept words joined by one space.

    Windows are judged on the input. A window starts earlier in a document of smaller id, nulls first; rows that share
    an id are told apart by the hash of their text, and rows that share both count as one document, so neither
    removes the other's words. Null and empty texts have no words. An empty table gives no rows.
    """
    spark, docs = docs.sparkSession, placed(docs, id_col, text_col)
    marks = written(repeated_spans(docs), "marks")
    touched = BitFilter(spark, marks.select(F.col("th").alias("h")))

    def digest(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, str]:
        kept = words if gone is None else [w for w, drop in zip(words, gone.tolist()) if not drop]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    def untouched(batches: Batches) -> Batches:
        """Documents that no mark can concern are done; the others keep their text."""
        for batch in batches:
            wait = touched(batch.column(2).to_numpy().view(np.uint64)).tolist()
            done = [(None, None, None) if later else digest(words_of(x.as_py()), None)
                    for x, later in zip(batch.column(3), wait)]
            n, removed, sha = zip(*done) if done else ((), (), ())
            left = pa.array([x.as_py() if later else None for x, later in zip(batch.column(3), wait)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], left, pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(sha, pa.string())], ["doc_id", "doc", "th", "text", "n_words", "n_removed", "kept_sha256"])

    def finish(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kept_sha256"] is None:
                    words = words_of(row["text"])
                    out.append((row["doc_id"], *digest(words, covered(words, row["marks"]))))
                else:
                    out.append((row["doc_id"], row["n_words"], row["n_removed"], row["kept_sha256"]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 [x.split()[0] for x in DIGEST.split(", ")])

    done = docs.select("doc_id", "doc", "th", "text").mapInArrow(untouched, "doc long, th long, text string, ".join(
        ["doc_id long, ", "n_words long, n_removed long, kept_sha256 string"]))
    return done.join(marks, ["doc", "th"], "left").select(
        "doc_id", "text", "n_words", "n_removed", "kept_sha256", "marks").mapInArrow(finish, DIGEST)


SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
k AS (
    SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS h
    FROM (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20)),
f AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM k),
g AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE nth > 1),
e AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d)
SELECT d.doc_id, len(any_value(w))::BIGINT AS n_words, count(g.j) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY d.doc_id"""


@query("op10_debruijn_repeats", SQL)
def debruijn_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return removal_digests(table(spark, folder, "documents"))
