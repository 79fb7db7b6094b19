"""Masked pseudo-likelihood: a small network predicts every token from the tokens on both sides of it.

A document's score is the sum of the conditional log-probabilities of its tokens. The network sees ``SIDE`` tokens to
the left and to the right; each place has its own embedding table, their sum goes through one tanh layer, and the
token is predicted in two steps, its class and then itself within the class, so that neither softmax is wide. Words
beyond the vocabulary are predicted as one of ``RARE`` hash classes, and their share of that class's tokens is added.

Training is data-parallel in rounds: every partition starts from the shared model, learns from the tokens of all its
documents that are masked in this round (each token is in one of the rounds), and sends its parameters; their mean, weighted by tokens, is the next shared model. Parameters are
averaged in chunks and in two steps, so no task or driver ever holds more than a bounded number of models.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, query, small_batches, table, texts, written

SIDE, HIDDEN, CLASSES = 2, 32, 32
VOCABULARY = CLASSES * CLASSES
RARE = 64                       # tokens that stand for all rarer words, by hash
PAD = VOCABULARY                # what lies beyond either end of a document
KEPT = 200_000                  # rarer words whose shares of their class every worker holds; the others are joined
BATCH, SLICE, RATE = 2048, 65_536, 0.08
TOGETHER = 4096                 # tokens that are scored at once, few enough for a processor's cache
COUNTED = 400_000
CHUNK, FAN = 2048, 256
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]
SHAPES = {"places": (len(PLACES), VOCABULARY + 1, HIDDEN), "bias": (HIDDEN,), "outer": (HIDDEN, CLASSES),
          "inner": (CLASSES, HIDDEN, CLASSES), "outer_bias": (CLASSES,), "inner_bias": (CLASSES, CLASSES)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name, as views into one vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def first_model() -> np.ndarray:
    flat = (0.1 * np.random.default_rng(7).standard_normal(SIZE)).astype(np.float32)
    for name in ("bias", "outer_bias", "inner_bias"):
        views(flat)[name][:] = 0
    return flat


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return VOCABULARY - RARE + zlib.crc32(word) % RARE


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words(text.as_py()))
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    def rows(counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                          ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Codes(dict):
    """Numbers of the words held here; of another word minus its class minus one, and the word is noted in ``left``."""

    left: list[bytes]

    def __missing__(self, word: bytes) -> int:
        self.left.append(word)
        return -1 - zlib.crc32(word) % RARE


class Shares:
    """Log share of each rarer word in the tokens of its class, where one token more stands for unseen words."""

    def __init__(self, counts: DataFrame, ids: dict[bytes, int]):
        spark = counts.sparkSession
        common = spark.createDataFrame([(bytearray(w),) for w in ids], "word binary")
        self.rare = written(counts.join(F.broadcast(common), "word", "left_anti"), "rare")
        totals = self.rare.groupBy((F.crc32("word") % RARE).alias("class")).agg(F.sum("n").alias("n")).collect()
        self.logs = np.zeros(RARE)
        for row in totals:
            self.logs[row["class"]] = np.log1p(row["n"])
        top = self.rare.orderBy(F.desc("n"), "word").limit(KEPT).collect()
        self.words = [bytes(r["word"]) for r in top]
        self.codes = np.array([zlib.crc32(w) % RARE for w in self.words], dtype=np.int64)
        self.kept = np.log(np.array([r["n"] for r in top], dtype=np.float64)) - self.logs[self.codes]

    def joined(self, met: DataFrame) -> DataFrame:
        """(row, more): the summed log shares of the words (row, word, k) that no worker holds."""
        logs = F.array(*[F.lit(float(x)) for x in self.logs])
        share = F.coalesce(F.log("n"), F.lit(0.0)) - F.get(logs, (F.crc32("word") % RARE).cast("int"))
        return met.join(self.rare, "word", "left").groupBy("row").agg(F.sum(F.col("k") * share).alias("more"))


def laid_out(listed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one row with ``SIDE`` pads around each, and where each one's tokens begin."""
    pads = np.full(SIDE, PAD, dtype=np.int32)
    sizes = np.array([len(x) for x in listed], dtype=np.int64)
    starts = SIDE + np.cumsum(sizes + SIDE) - (sizes + SIDE)
    return np.concatenate([pads, *(part for x in listed for part in (x, pads))]), starts


def hidden(m: dict[str, np.ndarray], row: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = np.take(m["places"][0], row[at + PLACES[0]], axis=0)
    for k, shift in enumerate(PLACES[1:], 1):
        z += np.take(m["places"][k], row[at + shift], axis=0)
    z += m["bias"]
    return np.tanh(z, out=z)


def powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column, less its greatest, which is taken away in place; and their sums."""
    z -= z.max(axis=0)
    e = np.exp(z)
    return e, e.sum(axis=0)


def by_class(tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the tokens in which those of a class stand together, and where those of each class then are."""
    classes = (tokens // CLASSES).astype(np.int16)          # short numbers are sorted by their digits
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(CLASSES + 1)).tolist()
    return order, [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


def predictions(m: dict[str, np.ndarray], h: np.ndarray, groups: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
    """What the softmax is taken of, for the classes and within the right class, with a column for each row of ``h``."""
    outer = m["outer"].T @ h.T
    outer += m["outer_bias"][:, None]
    inner, columns = np.empty_like(outer), h.T
    for k, these in groups:
        part = inner[:, these]
        np.matmul(m["inner"][k].T, columns[:, these], out=part)
        part += m["inner_bias"][k][:, None]
    return outer, inner


def log_probabilities(m: dict[str, np.ndarray], row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the tokens at ``at``, each given its neighbours on both sides."""
    total = np.empty(len(at))
    order, groups = by_class(row[at])
    at = at[order]
    outer, inner = predictions(m, hidden(m, row, at), groups)
    token, each = row[at], np.arange(len(at))
    sums = [np.log(powers(z)[1]).astype(np.float64) for z in (outer, inner)]
    total[order] = outer[token // CLASSES, each] - sums[0] + inner[token % CLASSES, each] - sums[1]
    return total


def learn(flat: np.ndarray, square: np.ndarray, row: np.ndarray, at: np.ndarray) -> None:
    """One AdaGrad step on the tokens at ``at``, in place."""
    m, n = views(flat), len(at)
    slope = np.zeros_like(flat)
    s = views(slope)
    order, groups = by_class(row[at])
    at = at[order]
    h = hidden(m, row, at)
    (outer, whole), (inner, part) = map(powers, predictions(m, h, groups))
    outer /= whole * n
    inner /= part * n
    token, each = row[at], np.arange(n)
    outer[token // CLASSES, each] -= 1 / n
    inner[token % CLASSES, each] -= 1 / n
    back = outer.T @ m["outer"].T
    s["outer"][:] = (outer @ h).T
    s["outer_bias"][:] = outer.sum(axis=1)
    for k, these in groups:
        error = inner[:, these]
        back[these] += error.T @ m["inner"][k].T
        s["inner"][k] = (error @ h[these]).T
        s["inner_bias"][k] = error.sum(axis=1)
    h *= h
    back *= np.subtract(1, h, out=h)
    s["bias"][:] = back.sum(axis=0)
    # all places at once: the slopes of equal neighbours at a place stand together and are summed
    near = np.concatenate([row[at + shift] + k * (VOCABULARY + 1) for k, shift in enumerate(PLACES)]).astype(np.int16)
    order = np.argsort(near, kind="stable")
    near = near[order]
    first = np.flatnonzero(np.diff(near, prepend=-1))
    s["places"].reshape(-1, HIDDEN)[near[first]] = np.add.reduceat(np.take(back, order % n, axis=0), first, axis=0)
    # parameters without a slope stay as they are
    step = slope * slope
    square += step
    np.sqrt(np.add(square, 1e-8, out=step), out=step)
    np.divide(slope, step, out=step)
    step *= RATE
    flat -= step


def train(docs: DataFrame, ids: dict[bytes, int], rounds: int, column: str = "text") -> np.ndarray:
    """The model learned from texts, or from the bytes of their tokens (16 bits each) in a column of that name."""
    spark = docs.sparkSession
    model = first_model()
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((ids, model))

        def run(batches: Batches, shared=shared, turn=turn) -> Batches:
            known, start = shared.value
            lookup, flat, square, seen = Ids(known), start.copy(), np.zeros(SIZE, dtype=np.float32), 0
            listed, size = [], 0

            def step():
                row, starts = laid_out(listed)
                # masked places shift with the document's length and the round; the rounds together cover every token
                at = [np.arange(s + (len(x) + turn) % rounds, s + len(x), rounds) for s, x in zip(starts, listed)]
                at = np.concatenate(at)
                np.random.default_rng(len(at)).shuffle(at)
                for i in range(0, len(at), BATCH):
                    learn(flat, square, row, at[i:i + BATCH])
                return len(at)

            for batch in batches:
                for text in batch.column(0):
                    if column == "tokens":
                        tokens = np.frombuffer(text.as_py(), dtype=np.int16)
                    else:
                        found = words(text.as_py())
                        tokens = np.fromiter(map(lookup.__getitem__, found), np.int32, len(found))
                    listed.append(tokens)
                    size += len(tokens)
                    if size > 8 * SLICE:
                        seen += step()
                        listed, size = [], 0
            if listed:
                seen += step()
            if seen:
                cut = [flat[i:i + CHUNK] for i in range(0, SIZE, CHUNK)]
                part = TaskContext.get().partitionId() % FAN
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut), part)), pa.array(np.arange(len(cut))),
                     pa.array(np.full(len(cut), float(seen))), pa.array([x.tobytes() for x in cut], pa.binary())],
                    ["part", "chunk", "weight", "values"])

        def mean(key, rows):
            weight = rows.column("weight").to_numpy()
            values = np.stack([np.frombuffer(x.as_py(), dtype=np.float32) for x in rows.column("values")])
            total = weight.sum()
            return pa.table({"part": pa.array([0], pa.int64()), "chunk": pa.array([key[-1].as_py()], pa.int64()),
                             "weight": pa.array([total]),
                             "values": pa.array([((weight / total) @ values).astype(np.float32).tobytes()])})

        fields = "part long, chunk long, weight double, values binary"
        sent = docs.select(column).mapInArrow(run, fields)
        near = sent.groupBy("part", "chunk").applyInArrow(mean, fields)
        rows = near.groupBy("chunk").applyInArrow(mean, fields).orderBy("chunk").collect()  # one model
        if rows:
            model = np.concatenate([np.frombuffer(r["values"], dtype=np.float32) for r in rows])
        shared.unpersist()
    return model


def pseudo_likelihood(docs: DataFrame, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, pll, pll_per_token) for every row: summed log-probabilities, all at most zero.

    Tokens are words in lower case. A word that is not among the most frequent ones has the probability of its hash
    class times its share of the class's tokens; shares of the less rare ones are held by every worker, the others are
    joined. The vocabulary is counted and the network trained over all documents. Null and empty texts have no tokens:
    ``pll`` is 0 and the mean is null. Null and repeated ids are scored row by row. An empty table gives no rows.
    """
    spark, docs = docs.sparkSession, texts(docs, id_col, text_col)
    small_batches(spark)
    counts = written(word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).collect()
    ids = {bytes(row["word"]): i for i, row in enumerate(top)}
    shares = Shares(counts, ids)
    # by number: first the words of the vocabulary, then the rarer ones that are held, last the classes from the end on
    token = np.concatenate([np.arange(len(ids)), VOCABULARY - RARE + shares.codes,
                            VOCABULARY - 1 - np.arange(RARE)]).astype(np.int16)
    share = np.concatenate([np.zeros(len(ids)), shares.kept, np.zeros(RARE)])
    shared = spark.sparkContext.broadcast(([*ids, *shares.words], token, share))

    def encode(batches: Batches) -> Batches:
        known, token, share = shared.value
        lookup = Codes(zip(known, range(len(known))))
        at_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            listed, held, ends, left, k = [], [], [0], [], []
            for text in batch.column(1):
                found, lookup.left = words(text.as_py()), []
                codes = np.fromiter(map(lookup.__getitem__, found), np.int64, len(found))
                listed.append(token[codes].tobytes())
                held.append(float(share[codes].sum()))
                rest = Counter(lookup.left)
                left += rest.keys()
                k += rest.values()
                ends.append(len(left))
            rest = pa.StructArray.from_arrays([pa.array(left, pa.binary()), pa.array(k, pa.int64())], ["word", "k"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at_row, at_row + len(batch))), batch.column(0), pa.array(listed, pa.binary()),
                 pa.array(held, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                ["row", "doc_id", "tokens", "held", "rest"])
            at_row += len(batch)

    # texts are cut into words once; training and scoring read the tokens
    fields = "row long, doc_id long, tokens binary, held double, rest array<struct<word: binary, k: long>>"
    coded = written(docs.mapInArrow(encode, fields), "tokens")
    model = spark.sparkContext.broadcast(train(coded, ids, rounds, "tokens"))

    def score(batches: Batches) -> Batches:
        m = views(model.value)
        for batch in batches:
            listed = [np.frombuffer(x.as_py(), dtype=np.int16) for x in batch.column(2)]
            row, starts = laid_out(listed)
            at = np.flatnonzero(row != PAD)
            each = np.zeros(len(row) + 1)
            for i in range(0, len(at), TOGETHER):
                each[at[i:i + TOGETHER]] = log_probabilities(m, row, at[i:i + TOGETHER])
            n = [len(x) for x in listed]
            total = [float(each[s:s + c].sum()) + x for s, c, x in zip(starts.tolist(), n, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(total, pa.float64())],
                ["row", "doc_id", "n_tokens", "pll"])

    scored = coded.select("row", "doc_id", "tokens", "held").mapInArrow(
        score, "row long, doc_id long, n_tokens long, pll double")
    met = coded.select("row", F.explode("rest").alias("rest")).select("row", "rest.word", "rest.k")
    whole = scored.join(shares.joined(met), "row", "left")
    whole = whole.withColumn("pll", F.col("pll") + F.coalesce("more", F.lit(0.0)))
    each = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", "pll", each.alias("pll_per_token"))


@query("op6_masked_lm")
def masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood(table(spark, folder, "documents"))
