"""Source divergence against plain counting, with every share of broadcast terms, and perfect hashes on their own."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from rillflow.llm import divergence as module
from rillflow.llm import perfect_hash
from rillflow.llm.divergence import divergence, term_lists
from rillflow.llm.perfect_hash import PerfectHashes, build, term_hash

DOCS = "doc_id string, text string, lang string, source string, docs int, term string, n int, v int, shard int, whole int"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return [t.translate(LOWER) for t in regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def expected(rows, least, ranks):
    docs = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= least) for s in {d[1] for d in own}}
        whole = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for source, c in groups.items():
            pairs = [(o, sum(abs(share(c, t) - share(d, t)) for t in kept)) for o, d in groups.items() if o != source]
            above = [(t, share(c, t) - share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", above, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def sample(n=160):
    rng, words = random.Random(5), ["Aa", "bÉ", "ça", "zz", "ZZ", "ü", "日本", "x1y", "o'k", "rare", "𝕏", "long" * 30]
    rows = [(" ".join(rng.choices(words, weights=range(1, 13), k=rng.randrange(12))), rng.choice("ab"), f"s{rng.randrange(5)}")
            for _ in range(n)]
    rows += [(None, "a", "s1"), ("", None, None), ("aa zz", None, "s2"), ("aa " * 400_000, "a", "s3"), ("zz", "c", "only")]
    return rows + [rows[0]] * 50


@pytest.mark.parametrize("most", [0, 5, 1 << 20])
def test_against_plain_counts(spark, most, monkeypatch):
    for name, value in (("SHARD", 4), ("TILE", 2), ("WORDS", 50), ("HELD", 400), ("CHUNK", 1000)):
        monkeypatch.setattr(module, name, value)
    rows = sample()
    docs = spark.createDataFrame([(str(i), *r, 1, "t", 2, 3, 4, 5) for i, r in enumerate(rows)], DOCS).repartition(3)
    got = divergence(docs, least_docs=8, ranks=3, most=most).collect()
    assert sorted(map(tuple, got)) == expected(rows, 8, 3)


def test_nothing_kept_and_nothing_there(spark):
    docs = spark.createDataFrame([("1", t, "a", s, 1, "", 1, 1, 1, 1) for t, s in (("x y", "s"), ("z", "t"), (None, "u"))], DOCS)
    assert sorted(map(tuple, divergence(docs).collect())) == expected([("", "a", s) for s in "stu"], 30, 50)
    assert divergence(docs.limit(0)).count() == 0


def table_of(sets, count=3):
    rows = []
    for name, terms in sets.items():
        for shard in range(count):
            own = [t for t in terms if (term_hash(t) >> 32) % count == shard]
            sizes, bits, keys, placed = build(own, np.array([perfect_hash.term_hash(t) for t in own], dtype=np.uint64))
            assert sorted(keys) == sorted(own)
            rows.append({"name": name, "shard": shard, "shards": count, "sizes": sizes, "bits": bits, "keys": keys,
                         "placed": placed})
    random.Random(1).shuffle(rows)
    return pa.Table.from_pylist(rows, pa.schema([("name", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()),
                                                 ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()),
                                                 ("keys", pa.list_(pa.binary())), ("placed", pa.int32())]))


def test_slots_are_dense_and_strangers_have_none():
    sets = {"a": [b"t%d" % i for i in range(5000)], "b": [b"t%d" % i for i in range(4000, 4200)], "c": [b""]}
    hashes = PerfectHashes(table_of(sets))
    asked = [b"t%d" % i for i in range(10_000)] + [b""]
    digests = np.array([term_hash(t) for t in asked], dtype=np.uint64)
    for name, terms in sets.items():
        slots = hashes.lookup(name, pa.array(asked, pa.binary()), digests)
        low, width = hashes.slots_of(name)
        assert width == len(terms)
        assert sorted(slots[slots >= 0].tolist()) == list(range(low, low + width))
        assert {t for t, s in zip(asked, slots) if s >= 0} == set(terms)
        assert all(hashes.keys[int(s)].as_py() == t for t, s in zip(asked, slots) if s >= 0)
    assert (hashes.lookup("z", pa.array(asked, pa.binary()), digests) == -1).all()


def test_terms_of_one_hash(monkeypatch):
    same = lambda t: term_hash(t[:1])
    monkeypatch.setattr(perfect_hash, "term_hash", same)
    terms = [b"aa", b"ab", b"ac", b"b", b"ca", b"cb"]
    rows = []
    sizes, bits, keys, placed = build(terms, np.array([same(t) for t in terms], dtype=np.uint64))
    rows = [{"name": "x", "shard": 0, "shards": 1, "sizes": sizes, "bits": bits, "keys": keys, "placed": placed}]
    hashes = PerfectHashes(pa.Table.from_pylist(rows, pa.schema([
        ("name", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("sizes", pa.list_(pa.int32())),
        ("bits", pa.binary()), ("keys", pa.list_(pa.binary())), ("placed", pa.int32())])))
    asked = [*terms, b"ad", b"cc", b"bb"]
    slots = hashes.lookup("x", pa.array(asked, pa.binary()), np.array([same(t) for t in asked], dtype=np.uint64))
    assert sorted(slots[:6].tolist()) == list(range(6)) and slots[6:].tolist() == [-1] * 3


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 7)
    text = "Ab,cd É1é [x]_y`z{|}~ " * 9 + "q" * 40
    assert [t.decode() for part in term_lists(text.encode()) for t in part] == terms_of(text)
    assert [*term_lists(b"")] == []
