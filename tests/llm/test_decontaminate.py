"""Spaced seeds: complete masks, and leaks against a comparison of all windows."""

import random
from itertools import combinations

from rillflow.llm import decontaminate
from rillflow.llm.decontaminate import LEAST, MASKS, SPAN, WINDOW, leaks, without_leaks

DOCS = "doc_id long, text string, item_id string, seed int, gone_id int, th string"
ITEMS = "item_id long, text string, doc_id string, near int"


def test_masks_find_every_pattern_of_substitutions():
    for wrong in combinations(range(WINDOW), WINDOW - LEAST):
        assert any(not set(wrong) & {at + o for o in mask} for mask in MASKS for at in range(WINDOW - SPAN + 1))
    assert all(mask[0] == 0 and mask[-1] == SPAN - 1 for mask in MASKS)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS))


def best(doc, item):
    d, b = doc.lower().split(), item.lower().split()
    top = 0
    for shift in range(-len(b), len(d) + 1):
        same = [0 <= j + shift < len(d) and d[j + shift] == w for j, w in enumerate(b)]
        for at in range(-WINDOW, len(b)):
            top = max(top, sum(same[max(0, at):max(0, at + WINDOW)]))
    return top


def test_all_windows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            part = rng.choice(items)[1].split()[rng.randrange(5):]
            part = [w if rng.random() > 0.12 else word() for w in part]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, " ".join(words)))
    got = {(r.doc_id, r.item_id): r.best_match for r in leaks(*frames(spark, docs, items)).collect()}
    want = {(i, k): best(d, b) for i, d in docs for k, b in items}
    assert got == {k: v for k, v in want.items() if v >= LEAST} and len(got) > 10


def test_odd_rows(spark):
    item = " ".join(f"word{i}" for i in range(30))
    loud = item.upper().replace(" ", ", ")
    docs = [(1, "before " + loud + " after"), (2, None), (3, ""), (4, "?!"), (None, item), (5, item), (5, item),
            (5, "clean text of the same id"), (6, "x " * 60_000 + item), (7, " ".join(item.split()[:11])), (8, "word0")]
    items = [(10, item), (10, item), (11, None), (12, ""), (13, "too short"), (None, "other " * 3)]
    d, b = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): r.best_match for r in leaks(d, b).collect()}
    assert got == {(1, 10): 15, (None, 10): 15, (5, 10): 15, (6, 10): 15}
    left = without_leaks(d, b).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id != 2) == sorted(
        [(3, ""), (4, "?!"), (5, "clean text of the same id"), docs[9], docs[10]])
    assert len(left) == 6 and all((r.seed, r.gone_id, r.th) == (1, 2, "y") for r in left)


def test_many_seeds_shuffle_numbers_and_each_text_once(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30))) for i in range(6)]
    docs = [(i, " ".join([f"x{rng.randrange(99)}" for _ in range(50)] + items[i % 6][1].split()[i % 5:])) for i in range(30)]
    docs += [(1, docs[1][1]), (100, docs[1][1]), (None, docs[2][1]), (101, None), (102, "short"), (1, docs[4][1])]
    d, b = frames(spark, docs, items)
    want = sorted(map(tuple, leaks(d, b).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    found = leaks(d, b)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) > 30
    assert sorted(r.doc_id for r in without_leaks(d, b).collect()) == [101, 102]
    # of all that is shuffled below the join on seeds, nothing carries the list of words
    joined = []

    def walk(plan):
        if plan.nodeName() == "Join" and "seed" in plan.condition().toString():
            joined.append(plan.left().output().toString() + plan.right().output().toString())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(found._jdf.queryExecution().optimizedPlan())
    assert len(joined) == 1 and "listed" not in joined[0] and "near" in joined[0]


def test_empty_tables(spark):
    item = " ".join(f"word{i}" for i in range(30))
    for docs, items in (([], [(1, item)]), ([(1, item)], []), ([], [])):
        d, b = frames(spark, docs, items)
        assert leaks(d, b).count() == 0 and without_leaks(d, b).count() == len(docs)
