"""Repeated passages against a search of all windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rillflow.llm.debruijn import WINDOW, Spans, paths, placed, remove_repeats, removal_digests, sliding_min

SCHEMA = "doc_id long, text string, th string, doc int, row string, marks int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(parts)


def words(text):
    return (text or "").encode().split()


def removed(rows):
    """Which words of each distinct (id, text) go, by a set of all windows met so far."""
    order = sorted({(i is not None, i or 0, _signed(t), t) for i, t in rows})
    seen, out = set(), {}
    for known, i, _, t in order:
        w = words(t)
        gone = set()
        for at in range(len(w) - WINDOW + 1):
            window = tuple(w[at:at + WINDOW])
            if window in seen:
                gone |= set(range(at, at + WINDOW))
            seen.add(window)
        out[(i if known else None, t)] = gone
    return out


def _signed(text):
    import xxhash

    if text is None:
        return 42
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def digest(i, t, gone):
    w = words(t)
    kept = [x for j, x in enumerate(w) if j not in gone]
    return (i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())


def compare(spark, rows, parts=3):
    gone = removed(rows)
    want = sorted((digest(i, t, gone[i, t]) for i, t in rows), key=str)
    got = sorted((tuple(r) for r in removal_digests(frame(spark, rows, parts)).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_dense_repeats(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcde") + str(rng.randrange(4)) for _ in range(rng.randrange(20, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            passage = rng.choice(passages)
            a = rng.randrange(len(passage))
            parts += rng.choice([passage, passage[a:], passage[:a], [rng.choice("ab")] * rng.randrange(30), ["x y", "z"]])
        rows.append((i, " ".join(parts)))
    compare(spark, rows)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    compare(spark, [
        (1, passage), (1, passage), (2, None), (3, ""), (4, " \t\n"), (None, passage + " end"), (None, "start " + passage),
        (5, "a " * 3000), (6, passage.replace(" ", "\n")), (7, "x" * 100_000), (1, "other " + passage), (8, "a " * 25),
        (9, " ".join(str(i) for i in range(20_000))), (10, " ".join(str(i) for i in range(5_000, 6_000)))])


def test_empty_table(spark):
    assert removal_digests(frame(spark, [], 1)).count() == 0
    assert remove_repeats(frame(spark, [], 1)).count() == 0


def test_texts_keep_the_rest_as_it_was(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"one\n\n{passage}\ttwo"), (2, f"  three\n{passage}\n\nfour  five"), (3, passage), (4, "six  seven"), (5, None)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows)).collect()}
    assert [got[i].text for i in range(1, 6)] == [rows[0][1], "  three four  five", "", "six  seven", None]
    assert all((r.th, r.doc, r.row, r.marks) == ("x", 1, "y", 2) for r in got.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"cc"]), max_size=80))
def test_paths_cover_every_window_once_under_a_common_anchor(listed):
    found = paths(listed, window=6, anchor=2)
    if len(listed) < 6:
        assert found is None
        return
    spans, starts, sizes, anchors = found
    assert starts.tolist() == np.r_[0, np.cumsum(sizes)[:-1]].tolist() and sizes.sum() == len(listed) - 5
    under = {}
    for start, size, anchor in zip(starts.tolist(), sizes.tolist(), anchors.tolist()):
        for at in range(start, start + size):
            assert under.setdefault(tuple(listed[at:at + 6]), anchor) == anchor
        assert size <= 5


def test_span_hashes_depend_on_the_words_alone():
    listed = [b"a", b"b", b"c"] * 2000
    spans = Spans(listed)
    got = spans(np.arange(0, 5970, 3), 10)
    assert len(set(got.tolist())) == 1 and spans(np.array([1]), 10)[0] != got[0]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in range(1, 20):
        assert sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(len(x) - width + 1)]


def test_text_hash_is_the_one_of_the_store(spark):
    rows = [(1, "é漢 x"), (2, ""), (3, None)]
    got = {r.doc_id: r.th for r in placed(frame(spark, rows)).collect()}
    assert got == {i: _signed(t) for i, t in rows}
