"""The trie of rebuilt conversations against plain dictionaries, with upper nodes at any depth."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from rillflow.llm import prefix_trie as module
from rillflow.llm.prefix_trie import DoubleArray, prefix_trie

TURNS = "text string, conv_id long, turn long, role string, conv int, d int, key string, words int, depth int, a int, shard int"


def key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(found)] for c, found in turns.items()}
    paths = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        paths[c] = tuple(own.get(base, [])[:h] + found[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, found in members.items():
        worth = (len(found) - 1) * len(regex.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += worth
            leaves[path[:d]] += not children[path]
    return sorted((min(found), len(path), min(members[path[:-1]]) if path else -1, len(found), children[path], leaves[path],
                   saved[path], hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
                  for path, found in members.items())


def result(spark, rows, **options):
    data = [(text, conv, turn, role, *[1] * 2, "k", *[2] * 4) for conv, turn, role, text in rows]
    got = prefix_trie(spark.createDataFrame(data, TURNS).repartition(4), **options).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def sample():
    rng, rows = random.Random(8), []
    said = ["", "a b", "a  b", "c\nd e", "é 𝕏", None]
    for conv in [*range(70), 1003, 1020, 5, -7]:
        for turn in range(rng.randrange(6)):
            role = rng.choice(["user", "assistant", "", None])
            rows.append((conv, rng.choice([turn, turn, None]), role, rng.choice(said)))
    rows += [(c, t, "user", "the same copy") for c in range(200, 260) for t in range(5)]     # one sequence after rebuilding
    return rows + rows[:9] + [(None, 0, "user", "nobody"), (77, 0, "user", "x")]


@pytest.mark.parametrize("shard_turns", [1, 40, 10_000])
def test_against_dictionaries(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(module, "BUCKET", 3)
    rows = sample()
    assert result(spark, rows, shard_turns=shard_turns) == expected(rows)


def test_a_conversation_with_most_turns(spark, monkeypatch):
    monkeypatch.setattr(module, "BUCKET", 20)
    rows = [(20, t, "user", f"w{t % 7}") for t in range(250)] + [(40, 0, "user", f"w{t}") for t in range(60)]
    rows += [(21 + c, t, "user", f"w{t % 7}") for c in range(4) for t in range(4 + c)]
    assert result(spark, rows, shard_turns=30) == expected(rows)


def test_little(spark):
    assert result(spark, []) == [] and result(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(1, 0, None, None)], [(c, 0, "user", "x y") for c in (1, 2, 41)]):      # some of them left without turns
        assert result(spark, rows) == expected(rows)
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "x") for c in turnless]
    assert [r[:6] for r in result(spark, rows)] == [(turnless[0], 0, -1, 3, 0, 1)]


def test_double_array():
    rng = np.random.default_rng(4)
    words = sorted({tuple(rng.integers(0, 40, rng.integers(1, 7)).tolist()) for _ in range(900)} | {(5000,), (5000, 4999, 0)})
    trie, states = DoubleArray(), np.zeros(len(words), dtype=np.int64)
    for level in range(6):
        on = np.array([len(w) > level for w in words])
        states[on] = trie.extend(states[on], np.array([w[level] for w in words if len(w) > level], dtype=np.int64))
    prefixes = {w[:d + 1] for w in words for d in range(len(w))}
    assert (trie.check != -1).sum() == len(prefixes) + 1
    for word in [*prefixes, (41,), (3, 3, 3, 3, 3, 3, 3), (5000, 1)]:
        at = np.zeros(1, dtype=np.int64)
        for label in word:
            at = trie.go(at, np.array([label]))
            if at[0] < 0:
                break
        assert (at[0] > 0) == (word in prefixes)
