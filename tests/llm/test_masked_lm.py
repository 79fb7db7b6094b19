"""Masked pseudo-likelihood: a proper distribution, right gradients, and scores that follow what was learned."""

import numpy as np
import pytest
from rillflow.llm import masked_lm as lm

SCHEMA = "doc_id long, text string, word string, n int, chunk int"


def test_each_token_is_predicted_from_both_sides_by_a_distribution():
    flat = lm.first_model() * 5
    m = lm.views(flat)
    listed = [np.array([3, 700, 5], dtype=np.int32), np.array([], dtype=np.int32), np.array([9], dtype=np.int32)]
    row, starts = lm.laid_out(listed)
    assert [row[s:s + len(x)].tolist() for s, x in zip(starts, listed)] == [x.tolist() for x in listed]
    at = starts[0] + 1
    total = 0.0
    for token in range(lm.VOCABULARY):
        changed = row.copy()
        changed[at] = token
        total += np.exp(lm.log_probabilities(m, changed, np.array([at]))[0])
    assert total == pytest.approx(1, abs=1e-4)
    before = lm.log_probabilities(m, row, np.array([at]))[0]
    for side in (-1, 1):
        changed = row.copy()
        changed[at + side] = 8
        assert lm.log_probabilities(m, changed, np.array([at]))[0] != before


def test_gradient_against_differences():
    flat = lm.first_model().astype(np.float64) * 3
    row, _ = lm.laid_out([np.array([1, 40, 2, 700, 3, 40, 9], dtype=np.int32)])
    at = np.flatnonzero(row != lm.PAD)
    loss = lambda x: -lm.log_probabilities(lm.views(x), row, at).mean()
    moved, square = flat.copy(), np.zeros(lm.SIZE)
    lm.learn(moved, square, row, at)
    slope = np.sqrt(square) * np.sign(flat - moved)
    used = np.argsort(-np.abs(slope))[:40]
    for i in used:
        step = np.zeros(lm.SIZE)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, rel=1e-3, abs=1e-7)


def test_scores(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 20) for i in range(60)]
    rows += [(100, "mat the on sat cat the ran dog and the " * 20), (101, None), (102, ""), (None, "the cat"), (1, rows[1][1]),
             (103, "the cat " * 40_000), (104, "unknownword")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    got = lm.pseudo_likelihood(docs).collect()
    assert len(got) == len(rows) and all(r.pll <= 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == 200 and by[0].pll_per_token == pytest.approx(by[0].pll / 200)
    assert by[0].pll_per_token > by[100].pll_per_token                  # order counts
    assert (by[101].n_tokens, by[101].pll, by[101].pll_per_token) == (0, 0.0, None) == tuple(by[102])[1:]
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [0, 1, 200_000])
def test_rare_words_have_their_share_of_the_class(spark, monkeypatch, kept):
    monkeypatch.setattr(lm, "KEPT", kept)
    common = " ".join(f"c{i} c{i} c{i} c{i} c{i} c{i} c{i} c{i} c{i}" for i in range(lm.VOCABULARY - lm.RARE))
    by_class = {}
    for i in range(300):
        by_class.setdefault(lm.zlib.crc32(f"r{i}".encode()) % lm.RARE, []).append(f"r{i}")
    often, once = next(v for v in by_class.values() if len(v) > 1)[:2]
    rows = [(0, common), (1, f"{often} c0"), (2, f"{once} c0"), (3, f"{often} c0 {often} {often} {often} {often}"),
            (1, "c1"), (None, f"{once} c0"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = lm.pseudo_likelihood(docs).collect()
    assert len(got) == len(rows)
    a, b, c = (next(r.pll for r in got if r.doc_id == i and r.n_tokens == 2) for i in (1, 2, None))
    assert a - b == pytest.approx(np.log(6 / 2), abs=1e-4) and b == pytest.approx(c)


def test_rounds_cover_every_token(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "learn", lambda flat, square, row, at: seen.append(len(at)))
    rows = [(i, " ".join("ab" * 3 if i % 2 else "c" for _ in range(i))) for i in range(1, 20)]

    class Docs:
        """Runs the partitions here, so that the calls are counted."""
        sparkSession = spark
        select = lambda self, *_: self

        def mapInArrow(self, run, _):
            import pyarrow as pa
            monkeypatch.setattr(lm.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda s: 0})()))
            list(run(iter([pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})])))
            return spark.createDataFrame([], "part long, chunk long, weight double, values binary")

    lm.train(Docs(), {b"c": 0}, 2)
    assert sum(seen) == sum(i for i, _ in rows)


def test_counts(spark):
    docs = spark.createDataFrame([(1, "A a b\nÉ"), (2, None), (3, "a")], "doc_id long, text string")
    assert {bytes(r.word).decode(): r.n for r in lm.word_counts(docs).collect()} == {"a": 3, "b": 1, "é": 1}


def test_tokens_written_once_train_the_same_model(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * (i % 7)) for i in range(40)] + [(None, "a rare one"), (50, None)]
    ids = {w.encode(): i for i, w in enumerate(["the", "cat", "sat", "on", "mat"])}
    lookup = lm.Ids(ids)
    coded = [(bytearray(np.array([lookup[w] for w in lm.words(t)], dtype=np.int16).tobytes()),) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tokens = spark.createDataFrame(coded, "tokens binary").coalesce(1)
    assert np.array_equal(lm.train(docs, ids, 2), lm.train(tokens, ids, 2, "tokens"))
