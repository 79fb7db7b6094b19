"""Prefix trees: reversible template, shared nodes once, attention over exactly the ancestors."""

import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from rillflow.llm.prefix_tree import conversations, digests, escape, prefix_tree, read_turns, template, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, path string, at int"
CONTROL = st.lists(st.sampled_from(["<|end|>\n", "<|user|>\n", "</s>", "[INST]", "\\", "\\l", "|", "a", "\n", "é", "漢"])) \
    .map("".join)


@given(CONTROL)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    said = escape(text)
    assert unescape(said) == text and not set(said) & set("<[|")


@given(st.lists(st.tuples(st.one_of(st.none(), CONTROL), CONTROL)))
def test_template_is_reversible(turns):
    assert read_turns("".join("".join(template(*t)) for t in turns)) == turns


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    out = {}
    none_first = lambda x: (x is not None, x or type(x)() if x is not None else 0)
    for conv, turns in convs.items():
        turns.sort(key=lambda t: tuple(none_first(x) for x in t))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        size = sum(len("".join(template(r, t))) for _, r, t in turns)
        out[conv] = (conv, len(turns), sha(said), len(loss), sha(loss), size)
    return out


def run(spark, rows, parts=4):
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    trees, members = prefix_tree(turns, PATH)
    return trees, members, digests(conversations(trees, members), PATH)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] <|end|>\n"), (2, 0, "user", "hi"),
            (2, 1, "assistant", None), (3, None, "user", "hi"), (4, 0, None, "x"), (5, 0, "", "x"), (None, 0, "user", "a"),
            (None, 1, "assistant", "b"), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (7, 0, "assistant", ""),
            (8, 0, "user", "long " * 40000), (8, 1, "assistant", "é漢" * 9000), (9, 0, "user", "hi"), (9, 1, "assistant", "b")]
    trees, members, got = run(spark, rows)
    assert {r.conv_id: tuple(r) for r in got.collect()} == brute(rows)


def test_shared_turns_once_with_ancestors(spark):
    rows = []
    for conv in range(120):
        path = [conv % 2, conv % 4, conv % 12, conv]
        rows += [(conv, i, "user" if i % 2 == 0 else "assistant", f"said {x}") for i, x in enumerate(path)]
    trees, members, got = run(spark, rows)
    assert {r.conv_id: tuple(r) for r in got.collect()} == brute(rows)
    nodes = sorted(trees.collect(), key=lambda r: r.at)
    assert len(nodes) == 2 + 4 + 12 + 120
    at = 0
    seen = {}
    for node in nodes:
        assert node.at == at and node.n == len(node.ids)                 # depth-first, gapless
        at += node.n
        chain = [(x["at"], x["n"]) for x in node.attends]
        assert node.position == sum(n for _, n in chain)
        assert node.tree == (chain[0][0] if chain else node.at)
        if chain:                                                        # the parent's ancestors and the parent
            assert chain == [*seen[chain[-1][0]], chain[-1]]
        seen[node.at] = chain
    assert {r.leaf for r in members.collect()} <= set(seen)


def test_empty_table(spark):
    trees, members, got = run(spark, [], 1)
    assert trees.count() == members.count() == got.count() == 0
