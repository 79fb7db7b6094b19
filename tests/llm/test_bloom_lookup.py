"""Lookup sketches against sets of paragraphs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from rillflow.llm import bloom_lookup as module
from rillflow.llm.bloom_lookup import PARAGRAPH, Sketches, differing, digests, fingerprints

DOCS = "text string, doc_id long, part int, edge int, row long, th string, n_chars int"


def near(a, b):
    one, two = Counter(PARAGRAPH.findall(a)), Counter(PARAGRAPH.findall(b))
    shared, whole = (one & two).total(), (one | two).total()
    return shared / whole if whole else 1.0


def expected(docs):
    """By id: n_chars, sha256 and likenesses; ids have to differ."""
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    out = {}
    for at, (doc_id, text) in enumerate(order):
        other, half = order[(at + 1) % len(order)][1], len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, other))
    return out


def frame(spark, docs, parts):
    return spark.createDataFrame([(t, i, 1, 2, 3, "x", 4) for i, t in docs], DOCS).repartition(parts)


def test_small_tables(spark):
    rng = random.Random(3)
    pool = ["One. ", "Two two! ", "Drei?\n", "\n", "é𝕏 four", "Five.", " six. "]
    docs = [(7 * i, "".join(rng.choices(pool, k=rng.randrange(30)))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, "A. " * 30_000), (4, "x" * 90_000), (5, "".join(f"{i}. " for i in range(5000))), (-9, "a")]
    got = fingerprints(frame(spark, docs, 5)).collect()
    want = expected(docs)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want and len(got) == len(docs)
    by_text = {}
    for r in got:
        assert by_text.setdefault((dict(docs)[r.doc_id] or ""), r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = fingerprints(docs.repartition(7)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want


def test_repeated_rows_null_ids_and_few_documents(spark):
    rows = [(1, "a. b.")] * 40 + [(None, "c.")] * 3 + [(2, "a. c. d.")] * 2 + [(1, "z.")]
    got = fingerprints(frame(spark, rows, 4)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert sum(r.near_next == 1 for r in got) >= 39 + 2 + 1
    for docs in ([(5, "one. two. three")], [(5, None)]):
        one = fingerprints(frame(spark, docs, 1)).collect()
        assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert fingerprints(frame(spark, [(1, "")], 1).limit(0)).count() == 0


@pytest.mark.parametrize("only", [0, 1, 9, 700])
def test_peeling_recovers_what_differs(only):
    rng = np.random.default_rng(only)
    both = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    first, second = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (only, only // 2))
    pairs = differing([np.r_[both, first], both, both[:0]], [np.r_[second, both], both, second])
    assert [tuple(set(x.tolist()) for x in p) for p in pairs] == [
        (set(first.tolist()), set(second.tolist())), (set(), set()), (set(), set(second.tolist()))]


def test_failure_is_seen_and_mended(monkeypatch):
    asked, of = [], Sketches.of
    monkeypatch.setattr(module.Sketches, "of", staticmethod(lambda k, o, n, size: asked.append((n, size)) or of(k, o, n, size)))
    many, few = digests("".join(f"{i}." for i in range(400))), digests("a. b.")
    (only, none), (two, _) = differing([many, few], [many[:0], few[:1]])
    assert len(only) == 400 and not len(none) and len(two) == 1
    assert asked[0] == (2, 4) and asked[2] == (1, 16) and asked[-1][1] >= 400 / 3


def test_repeats_of_a_paragraph_have_digests_of_their_own():
    assert len(set(digests("x\n" * 50).tolist())) == 50
    assert set(digests("a.b.a.").tolist()) == set(digests("b.a.a.").tolist()) > set(digests("a.b.").tolist())
    short = "".join(f"{chr(97 + i % 26)}{'' if i % 3 else 'b'}." for i in range(3000))
    assert len(set(digests(short).tolist())) == 3000
    assert not len(digests(""))
