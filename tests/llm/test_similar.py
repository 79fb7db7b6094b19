"""Groups by exact Jaccard similarity against all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from rillflow.llm import similar as sim
from rillflow.llm.simhash_grid import fingerprint, keep_one

SCHEMA = "doc_id long, text string, fp string, root int, th string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each id's group; rows have ids."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), i), i)
    return sorted((i, first[find(k)]) for k, (i, _) in enumerate(rows))


def planted(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 160))] for _ in range(12)]
    common, rows = [f"c{i}" for i in range(30)], []
    for i in range(n):
        words = list(base[rng.randrange(12) if i % 3 else 0])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(common + words if i % 4 == 0 else words)))
    return rows


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sim, "SAMPLED", 1)
    rows = [*planted(3, 150), (200, None), (201, " "), (202, "one two"), (203, "ONE two"), (204, "one")]
    got = sorted((r.doc_id, r.component_id) for r in sim.similar(frame(spark, rows)).collect())
    want = brute(rows)
    assert got == want and 10 < len({c for _, c in want}) < 140
    kept = keep_one(frame(spark, [*rows, (None, rows[0][1]), (None, "alone"), (7, rows[7][1])]), shingle=5, least=0.8)
    kept = kept.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, c in want})
    assert [r.text for r in kept if r.doc_id is None] == ["alone"] and {(r.fp, r.root, r.th) for r in kept} == {("x", 1, "y")}


def test_the_stage_seeks_links_by_the_grid_first(spark, monkeypatch):
    asked, links = [], sim.verified

    def spied(pairs, *rest):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return links(pairs, *rest)

    monkeypatch.setattr(sim, "verified", spied)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join("changed" if i % 50 == 33 else w for i, w in enumerate(words)))]
    rows += [(4, "something else altogether that nobody has said before")]
    keys = {i: sim.set_key(t, 5) for i, t in rows}
    prints = {i: fingerprint(t, 5) & (2**64 - 1) for i, t in rows}
    assert (prints[1] ^ prints[2]).bit_count() <= 3 < min((prints[3] ^ prints[i]).bit_count() for i in (1, 2))
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    assert {r.doc_id for r in kept} == {1, 4}
    assert asked[0] == {tuple(sorted((keys[1], keys[2])))}                  # before: the prefix join alone
    assert not asked[0] & (asked[1] | asked[2]) and asked[1] | asked[2]     # which is left what the grid misses


def test_grid_pairs(spark):
    rows = [(5, 0), (3, 0), (4, 0b111), (9, 0b111), (7, 0b1111 << 40), (8, -1)]
    alone = spark.createDataFrame(rows, "fp long, sh long").repartition(3)
    got = sorted((r.a, r.b) for r in sim.grid_pairs(alone).collect())
    assert got == [(3, 4), (3, 5), (4, 9)]
    assert sim.grid_pairs(alone.where(F.lit(False))).count() == 0


def test_one_row_of_each_key(spark):
    rows = [(k % 40 if k < 60 else k, [k % 40 if k < 60 else k]) for k in range(100)]
    sets = spark.createDataFrame(rows, "fp long, prefix array<long>").repartition(5)
    got = sorted((r.fp, r.prefix) for r in sim.one_each(sets).collect())
    assert got == [(k, [k]) for k in [*range(40), *range(60, 100)]]


def test_items_among_known_ones():
    items, known = np.array([-9, 0, 3, 8]), np.array([-9, 3, 7])
    assert sim.among(items, known).tolist() == [True, False, True, False]
    assert not sim.among(items, known[:0]).any() and not sim.among(items[:0], known).any()


def test_stage_drops_what_fingerprints_miss(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for at in (20, 80, 140):
        other = list(words)
        for k in (at, at + 25, at + 50):
            other[k] = "changed"
        near = " ".join(words), " ".join(other)
        a, b = map(plain_set, near)
        if bin((fingerprint(near[0]) ^ fingerprint(near[1])) & (2**64 - 1)).count("1") > 3:
            break
    else:
        raise AssertionError("no pair that fingerprints miss")
    assert len(a & b) >= 0.8 * len(a | b)
    rows = [(1, near[0]), (2, near[1]), (3, "something else altogether that nobody has said before")]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()} == {1, 3}


def test_parities_differ_in_no_more_items_than_sets():
    rng = np.random.default_rng(5)
    for size in (0, 3, 200, 5000):
        a = np.unique(rng.integers(-2**63, 2**63, size))
        b = np.unique(np.concatenate([a[size // 9:], rng.integers(-2**63, 2**63, size // 8)]))
        apart = sum((int(x) & (2**64 - 1)).bit_count() for x in sim.parity(a) ^ sim.parity(b))
        assert len(sim.parity(a)) * 64 == sim.PARITY and apart <= len(np.setxor1d(a, b))
        assert size != 200 or apart > 30


def test_parities_rule_out_pairs_of_large_sets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-2**63, 2**63, 3000)
    sets = {1: base, 2: np.concatenate([base[900:], rng.integers(-2**63, 2**63, 900)]),       # similarity 0.54
            3: np.concatenate([base[300:], rng.integers(-2**63, 2**63, 300)]), 4: base[:600], 5: base[:580]}
    sets = {k: np.unique(x) for k, x in sets.items()}
    rows = [(k, len(x), sim.parity(x).tolist(), sim.parity(x, sim.FINE).tolist() if len(x) > sim.LARGE else None)
            for k, x in sets.items()]
    alone = spark.createDataFrame(rows, "fp long, n int, bits array<long>, fine array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    left = {(r.a, r.b) for r in sim.may_link(spark.createDataFrame(pairs, "a long, b long"), alone, 0.8).collect()}
    assert left == {(1, 3), (4, 5)}         # before: (1, 2) too, as 1,024 bits are half full


def test_only_shared_first_shingles_stay(spark):
    rows = [(1, 9, [5, -7, 11]), (2, 9, [3, 5]), (3, 0, []), (4, 9, [-7])]
    alone = spark.createDataFrame(rows, "fp long, n int, prefix array<long>").repartition(3)
    got = {(r.fp, r.n, r.at, r.h) for r in sim.shared_only(alone).collect()}
    assert got == {(1, 9, 0, 5), (1, 9, 1, -7), (2, 9, 1, 5), (4, 9, 0, -7)}
    assert sim.shared_only(alone.where(F.lit(False))).count() == 0


def test_superseded_tables_go(spark, tmp_path):
    import os

    from rillflow.llm.common import discard, written

    kept, gone = (written(spark.range(3), "t") for _ in range(2))
    path = gone.inputFiles()[0].removeprefix("file:").lstrip("/")
    discard(gone, kept.where("id > 1"))
    assert kept.count() == 3 and not os.path.exists(f"/{path}")


def test_prefixes():
    assert [sim.prefix_size(n, 0.8) for n in (0, 1, 5, 10, 35)] == [0, 1, 2, 3, 8]


def test_empty_table(spark):
    assert keep_one(frame(spark, []), shingle=5, least=0.8).count() == 0
