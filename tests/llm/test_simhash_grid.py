"""Fingerprint groups against all pairs."""

import random

import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rillflow.llm.components import components
from rillflow.llm.simhash_grid import cell_masks, counts, fingerprint, fingerprint_links, keep_one, near_duplicates

SCHEMA = "doc_id long, text string, fp string, root int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.lists(st.sampled_from(["A", "b", "É", "the", "\n", "\t ", "\x1c"])).map(" ".join))
def test_fingerprint(text):
    assert fingerprint(text) == signed(plain_fingerprint(text))


def groups(values):
    """Smallest member of the component of each value under at most three differing bits."""
    values, root = sorted(set(values)), {}
    for v in values:
        root[v] = v

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def near(seed, n):
    rng = random.Random(seed)
    out = {0, signed(2**64 - 1), signed(1 << 63)}
    while len(out) < n:
        v = rng.choice([rng.getrandbits(64), rng.choice(sorted(out)) & (2**64 - 1)])
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        out.add(signed(v))
    return sorted(out)


def test_links_are_all_pairs_within_distance(spark):
    values = near(1, 600)
    got = {(r.a, r.b) for r in fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {(a, b) for i, b in enumerate(values) for a in values[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and len(want) > 100


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [
        (2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(70)] + [(-5, -(1 << 63))]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_bound_the_distance(spark):
    values = near(2, 200)
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", counts(F.col("v")).alias("c"))
    found = {r.v: r.c & (2**64 - 1) for r in df.collect()}
    pairs = lambda x: [x >> s & 3 for s in range(0, 64, 2)]
    for v, c in found.items():
        assert pairs(c) == [{0: 0, 1: 1, 2: 1, 3: 3}[p] for p in pairs(v & (2**64 - 1))]
    assert len(cell_masks(3)) == 20


def test_groups_of_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(300))
            for _ in range(8)]
    rows = [(i, rng.choice(base)) for i in range(40)]
    rows = [(i, t + " more" if i % 3 else t.upper()) for i, t in rows]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "ONE"), (105, "x " * 50_000), (40, rows[0][1]),
             (None, "lonely text here"), (None, "lonely text here"), (None, rows[0][1]), (7, rows[7][1])]
    fps = [fingerprint(t) for _, t in rows]
    root = groups(fps)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    want = sorted(((i, f, root[f], first.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == want

    kept = keep_one(frame(spark, rows)).collect()
    assert len(kept) == len(set(root[f] for f in fps))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(first.values())
    assert [r.text for r in kept if r.doc_id is None] == ["lonely text here"]
    assert all((r.fp, r.root, r.component_id) == ("x", 1, "y") for r in kept)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0
