"""Toxicity by a classifier chain: linear models in a fixed order, each seeing the probabilities of those before it.

The probabilities that a later model is trained with are out-of-fold ones, so that they are as unsure as they will be
on documents never seen. The models are fitted on a bounded, documented sample of labelled rows; all documents are
scored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, query, table

WORDS = regex.compile(r"\p{L}+")
CAPITALS = regex.compile(r"\p{Lu}+")
STEMS = range(6, 8)             # letters of a beginning that several words of a text share
FEATURES = (24, 96, 384)        # how many words a model may take; the out-of-fold predictions choose
MIN_DOCS, FOLDS, STEPS, RIDGE = 2, 4, 30, 0.1

# Category and the label expression that it is learned from; null: the row says nothing about the category.
CATEGORIES = (("junk", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_junk", "quality = 0 and toxic = 1"))


def features(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case, beginnings that several of them go on from, and signs of make-up.

    Beginnings and signs are written as words that no text can hold.
    """
    if not text:
        return {"=empty"}
    found = set(WORDS.findall(text.lower()))
    stems = Counter(w[:n] for w in found for n in STEMS if len(w) > n)
    if 4 * sum(map(len, CAPITALS.findall(text))) > len(text):
        found.add("=upper")
    if 20 * sum(text.count(c) for c in "#$%&*|<>!") > len(text):
        found.add("=symbols")
    return found | {"^" + stem for stem, n in stems.items() if n > 1}


class Linear:
    """Logistic regression over present words and a few dense inputs."""

    def __init__(self, words: dict[str, int], weights: np.ndarray, dense: np.ndarray, bias: float):
        self.words, self.weights, self.dense, self.bias = words, weights, dense, bias

    def logit(self, present: set[str], inputs: list[float]) -> float:
        hits = self.words.keys() & present
        return self.bias + sum(self.weights[self.words[w]] for w in hits) + float(self.dense @ inputs)


def chosen_words(docs: list[set[str]], y: np.ndarray, most: int) -> dict[str, int]:
    """The ``most`` words whose presence tells most about ``y``, by the G-test with its sign left aside."""
    seen: dict[str, list[int]] = {}
    for words, label in zip(docs, y.tolist()):
        for w in words:
            seen.setdefault(w, [0, 0])[int(label)] += 1
    kept = [(w, *n) for w, n in seen.items() if n[0] + n[1] >= MIN_DOCS]
    if not kept:
        return {}
    no, yes = (np.array([k[i] for k in kept], dtype=np.float64) for i in (1, 2))
    share = (y.sum() + 0.5) / (len(y) + 1)
    n = no + yes
    gain = yes * np.log(np.maximum(yes, 1e-9) / (n * share)) + no * np.log(np.maximum(no, 1e-9) / (n * (1 - share)))
    order = sorted(range(len(kept)), key=lambda i: (-gain[i], kept[i][0]))[:most]
    return {kept[i][0]: at for at, i in enumerate(order)}


def design(docs: list[set[str]], words: dict[str, int], inputs: np.ndarray) -> np.ndarray:
    """A row per document: presence of the words, the dense inputs, and a one for the bias."""
    x = np.zeros((len(docs), len(words) + inputs.shape[1] + 1))
    for i, doc in enumerate(docs):
        x[i, [words[w] for w in words.keys() & doc]] = 1
    x[:, len(words):-1] = inputs
    x[:, -1] = 1
    return x


def fit(docs: list[set[str]], inputs: np.ndarray, y: np.ndarray, most: int) -> Linear:
    """Ridge-penalised logistic regression by Newton steps, halved while they do not lower the loss."""
    words = chosen_words(docs, y, most)
    x = design(docs, words, inputs)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ w ** 2)

    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), slope)
        now, part = loss(w), 1.0
        while part > 1e-6 and loss(w - part * step) > now:
            part /= 2
        w = w - part * step
        if np.abs(part * step).max() < 1e-7:
            break
    d = len(words)
    return Linear(words, w[:d], w[d:-1], float(w[-1]))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def fit_chain(docs: list[set[str]], labels: np.ndarray, folds: np.ndarray) -> list[Linear | float]:
    """One model per category, a constant where all labels agree; ``labels`` holds nan where nothing is known."""
    chain: list[Linear | float] = []
    inputs = np.zeros((len(docs), 0))
    for y in labels.T:
        known = np.flatnonzero(~np.isnan(y))
        if len(set(y[known].tolist())) < 2:
            chain.append(float(y[known][0]) if len(known) else 0.0)
            inputs = np.c_[inputs, np.full(len(docs), chain[-1])]
            continue
        pick = lambda at: ([docs[i] for i in at], inputs[at], y[at])

        def out_of_fold(most: int) -> np.ndarray:
            out = np.zeros(len(docs))
            for fold in range(FOLDS):
                train, test = known[folds[known] != fold], np.flatnonzero(folds == fold)
                if len(set(y[train].tolist())) < 2:
                    out[test] = y[known].mean()
                    continue
                model = fit(*pick(train), most)
                out[test] = [sigmoid(model.logit(docs[i], inputs[i])) for i in test]
            return out

        def loss(out: np.ndarray) -> float:
            right = np.where(y[known] == 1, out[known], 1 - out[known])
            return -float(np.log(np.maximum(right, 1e-12)).sum())

        tried = [(out_of_fold(most), most) for most in FEATURES]
        out, most = min(tried, key=lambda x: loss(x[0]))
        chain.append(fit(*pick(known), most))
        inputs = np.c_[inputs, out]
    return chain


def predict(chain: list[Linear | float], present: set[str]) -> list[float]:
    found: list[float] = []
    for model in chain:
        found.append(model if isinstance(model, float) else sigmoid(model.logit(present, np.array(found))))
    return found


def toxicity(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, train_rows: int = 6000, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> for each category) for every document.

    The chain is fitted on at most ``train_rows`` labelled documents, those whose ids have the least hashes; of rows that
    repeat an id the one with the least text hash is learned from. Labels of one document that disagree count as positive; null labels leave their category open, rows with a null id are not
    learned from. Without labels for a category its probability is 0, if all agree it is what they say. Null and
    empty texts are scored by the feature that says so. Repeated rows come out as often as they came in.
    """
    spark = docs.sparkSession
    names = [c for c, _ in categories]
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), *[
        F.expr(e).cast("double").alias(c) for c, e in categories]).where(F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def listed(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([sorted(features(x.as_py())) for x in batch.column(len(names) + 1)],
                                               pa.list_(pa.string()))], [*batch.schema.names[:-1], "words"])

    fields = ", ".join(["doc_id long", *[f"{c} double" for c in names], "words array<string>"])
    # one row for each sampled id, chosen by hashes alone, so that copies of a document bring no more texts; both
    # broadcasts have at most train_rows rows
    copies = given.select("doc_id", F.xxhash64("text").alias("th")).join(F.broadcast(sample), "doc_id")
    copies = copies.groupBy("doc_id", *names).agg(F.min("th").alias("th"))
    once = given.withColumn("th", F.xxhash64("text")).join(F.broadcast(copies), ["doc_id", "th"])
    once = once.groupBy("doc_id", *names).agg(F.first("text").alias("text"))
    rows = once.select("doc_id", *names, "text").mapInArrow(listed, fields).toArrow()
    rows = rows.sort_by("doc_id")
    y = np.stack([rows.column(c).to_numpy() for c in names], axis=1) if len(rows) else np.zeros((0, len(names)))
    ids = rows.column("doc_id").to_numpy()
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    folds = ((mixed >> np.uint64(40)) % np.uint64(FOLDS)).astype(np.int64)
    chain = fit_chain([set(x) for x in rows.column("words").to_pylist()], y, folds)
    shared = spark.sparkContext.broadcast(chain)

    def score(batches: Batches) -> Batches:
        for batch in batches:
            found = [predict(shared.value, features(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))]],
                ["doc_id", *[f"p_{c}" for c in names]])

    return given.mapInArrow(score, ", ".join(["doc_id long", *[f"p_{c} double" for c in names]]))


@query("op7_toxicity_chain")
def toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumn("toxic", F.col("p_toxic") >= 0.5)
