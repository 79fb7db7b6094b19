"""Quality facts against plain Python; the estimation against known accuracies."""

import random
import re
from collections import Counter

import pytest
from rillflow.llm import weak_rules as w

SCHEMA = "doc_id long, text string, words string, hashes int, n_words string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(3)


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_facts(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b c ", " ", "\n", "\t", "#|", "é", "😀", "\x1c", "\x0b"])
                        for _ in range(rng.randrange(200)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \r\n"), (203, "a " * 50_000), (204, "x" * 200_000), (None, "a b"), (205, "a"),
             (205, "a"), (206, "one two three four five six seven eight " * 2), (207, "a\na \na\n\n\nb")]
    got = w.weak_quality(frame(spark, rows)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert all(not (r.base_failed and r.kept) and 0 <= r.quality <= 1 for r in got)


def test_estimation_finds_the_accuracies():
    rng = random.Random(9)
    share, trust = 0.8, [(0.97, 0.5), (0.95, 0.6), (0.99, 0.3), (0.9, 0.7), (0.96, 0.4)]
    votes = Counter()
    for _ in range(20_000):
        good = rng.random() < share
        votes[tuple(0 if rng.random() < 0.2 else 1 if rng.random() < (t[0] if good else 1 - t[1]) else 2 for t in trust)] += 1
    got, learned = w.learn(list(votes.items()), 200)
    assert got == pytest.approx(share, abs=0.05)
    for have, want in zip(learned, trust):
        assert have == pytest.approx(want, abs=0.08)


def test_verdict_follows_votes_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in w.weak_quality(docs).collect()}
    assert all(got[i].kept or got[i].base_failed or got[i].quality > 0.1 for i, q in labels.items() if q == 1)
    assert sum(got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed) >= 0.98 * sum(
        q == 1 and not got[i].base_failed for i, q in labels.items())
    assert sum(not got[i].kept for i, q in labels.items() if q == 0) >= 0.7 * sum(q == 0 for q in labels.values())


def test_empty_table(spark):
    assert w.weak_quality(frame(spark, [])).count() == 0
