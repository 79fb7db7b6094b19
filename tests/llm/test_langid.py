"""Language identification: the forward sums against all segmentations, and held-out accuracy."""

import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from rillflow.llm.langid import Guesser, Lattice, identify, letter_runs, pieces, with_language, word_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, held_out string, score int, word string"
VOCABULARY = {p: i for i, p in enumerate(["▁", "▁a", "a", "ab", "b", "bab", "ba"])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def segmentations(s, lattice):
    for cuts in product([0, 1], repeat=len(s) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(s)]
        parts = [s[a:b] for a, b in zip([0, *ends], ends)]
        ids = [lattice.ids.get(p, lattice.unknown if len(p) == 1 else None) for p in parts]
        if None not in ids:
            yield ids


@pytest.mark.parametrize("text", ["▁", "▁a", "▁abab", "▁bcab", "▁ccc", "▁aabbab"])
def test_sums_over_all_segmentations(text):
    lattice = Lattice(VOCABULARY)
    p = np.random.default_rng(3).random((9, 2))
    p[-1] = 0
    want = sum(np.prod([p[i] for i in ids], axis=0) for ids in segmentations(text, lattice))
    assert lattice.score([text, "▁x", text], p)[2] == pytest.approx(np.log(want))
    assert lattice.long_score(text, p) == pytest.approx(np.log(want))
    uses, total = np.zeros(9), 0
    for ids in segmentations(text, lattice):
        weight = np.prod(p[ids, 0])
        total += weight
        for i in ids:
            uses[i] += weight
    assert lattice.expect([text, text], np.array([2.0, 1.0]), p[:, 0])[:8] == pytest.approx((3 * uses / total)[:8])


def test_long_words_do_not_underflow():
    lattice = Lattice(VOCABULARY)
    p = np.full((9, 2), 0.01)
    p[-1] = 0
    got = lattice.score(["▁" + "ab" * 20_000], p)[0]
    assert np.isfinite(got).all() and got[0] < -50_000


@pytest.mark.parametrize("letters", [16, 30, 34, 36, 40])
def test_unseen_letters_do_not_underflow(letters):
    lattice = Lattice(VOCABULARY)
    p = np.full((9, 2), 1e-3)
    p[lattice.unknown] = 0.01 / 1e9, 0.02 / 1e9         # of a billion pieces
    p[-1] = 0
    text = "▁" + "ж" * letters
    want = np.log(1e-3) + letters * np.log(p[lattice.unknown])
    assert lattice.score([text, "▁a", text], p)[2] == pytest.approx(want)
    uses = lattice.expect([text, text], np.array([2.0, 1e9]), p[:, 0])
    assert uses[lattice.unknown] == pytest.approx((1e9 + 2) * letters) and uses[0] == pytest.approx(1e9 + 2)
    assert np.isfinite(uses).all() and uses[-1] == 0


@pytest.mark.parametrize("text", ["▁" + "ab" * 6 + "cbab" * 2, "▁" + "ab" * 9, "▁" + "cabbab" * 12])
def test_logs_give_what_products_give(text, monkeypatch):
    lattice = Lattice(VOCABULARY)
    p = np.random.default_rng(3).random((9, 2)) / 5
    p[-1] = 0
    run = lambda: (lattice.score([text, "▁a"], p), lattice.expect([text, "▁a"], np.array([2.0, 3.0]), p[:, 0]))
    got = [run()]
    for name, value in (("TABLED", 0), ("TABLED", 99), ("SMALL", np.inf)):
        monkeypatch.setattr(f"rillflow.llm.langid.{name}", value)
        monkeypatch.setattr("rillflow.llm.langid.STEP", 2.0 ** 10)
        got.append(run())
    for score, uses in got[1:]:
        assert score == pytest.approx(got[0][0]) and uses == pytest.approx(got[0][1])


def test_sums_that_lose_digits_on_the_way_are_taken_in_logs():
    lattice = Lattice({**VOCABULARY, "ж" * 31 + "a" * 9: 7})
    p = np.full((10, 1), 1e-3)
    p[lattice.unknown], p[-1] = 1e-17, 0
    text = "▁" + "ж" * 31 + "a" * 9             # whole, as the sums before its end vanish
    assert lattice.score([text], p)[0, 0] == pytest.approx(2 * np.log(1e-3))
    uses = lattice.expect([text], np.array([5.0]), p[:, 0])
    assert uses[[0, 7]] == pytest.approx([5, 5]) and uses.sum() == pytest.approx(10)


def test_pieces_are_sought_for_many_words_at_once(monkeypatch):
    class Spied(dict):
        asked = 0

        def get(self, *args):
            Spied.asked += 1
            return super().get(*args)

    rng = np.random.default_rng(5)
    texts = ["▁" + "".join(rng.choice(list("abcж漢"), rng.integers(0, 12))) for _ in range(300)]
    lattice = Lattice(Spied(VOCABULARY))
    p = rng.random((9, 2)) / 5
    p[-1] = 0
    n = np.arange(300.0)
    score, uses = lattice.score(texts, p), lattice.expect(texts, n, p[:, 1])
    assert Spied.asked == 0                                         # before: once for each stretch of each word
    assert score == pytest.approx(np.array([lattice.long_score(x, p) for x in texts]))
    monkeypatch.setattr("rillflow.llm.langid.TABLED", 0)
    assert uses == pytest.approx(lattice.expect(texts, n, p[:, 1]))


@pytest.mark.parametrize("vocabulary", [{}, {"▁": 0}, {"ab": 0, "b": 1}])
def test_small_vocabularies(vocabulary):
    lattice = Lattice(vocabulary)
    p = np.full((len(vocabulary) + 2, 1), 0.1)
    texts = ["▁ab", "▁", "ж"]
    assert lattice.score(texts, p) == pytest.approx(np.array([lattice.long_score(x, p) for x in texts]))


def test_words_of_letters_of_every_plane():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for text in (every, every[:0xF000], "aÉ² ½b_c-1d", "a𐐀b 𝔘1c", "Ⅷ一x", ""):
        assert letter_runs(text) == regex.findall(r"\p{L}+", text.lower())


def test_guesses_do_not_depend_on_what_is_remembered(monkeypatch):
    p = np.random.default_rng(3).random((9, 2))
    p[-1] = 0
    texts = [pa.array(["ab ba", None, "c 1", "aab"]), pa.array(["", "ba ab cab"])]
    guess = Guesser(VOCABULARY, ["x", "y"], p)
    want = [guess(x) for x in texts]
    assert list(guess.rows) == ["ab", "ba", "c", "aab", "cab"] and len(guess.scores) == 5
    monkeypatch.setattr("rillflow.llm.langid.SCORED", 0)
    guess = Guesser(VOCABULARY, ["x", "y"], p)
    assert [guess(x) for x in texts] == want and len(guess.rows) == 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs, PATH, rounds=1).collect()
    assert len(got) == len(langs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.98 * len(out) > 100


def test_odd_rows(spark):
    en, fr = "the thing that they think about", "les choses que vous aimez être"
    rows = [(i, [en, fr][i % 2], ["en", "fr"][i % 2]) for i in range(40)]
    rows += [(50, None, "en"), (51, "", "fr"), (52, "123 ?! ²", "en"), (53, "x" * 100_000, None), (None, en, "de"),
             (54, en + " " + "the " * 50_000, None), (1, fr, "fr"), (55, "漢字", None), (56, fr, None)]
    got = identify(frame(spark, rows), PATH).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en", "fr", "und"}   # a null id teaches nothing
    assert [by[i].lang_pred for i in (50, 51, 52, 54, 56)] == ["und", "und", "und", "en", "fr"]
    assert by[None].lang_pred == "en" and not by[None].held_out and by[50].score == 0
    kept = with_language(frame(spark, rows), PATH).collect()
    assert {r.doc_id for r in kept} == {i for i, _, _ in rows} - {50, 51, 52}
    assert all((r.held_out, r.score, r.word) == ("x", 1, "y") for r in kept)


def test_prediction_ignores_language_source_and_id(spark):
    en, fr = "the thing that they think about", "les choses que vous aimez être"
    train = [(i, [en, fr][i % 2], ["en", "fr"][i % 2]) for i in range(40)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 0][:2]
    for lang in ("en", None):
        got = {r.doc_id: r for r in identify(frame(spark, [*train, (held[0], fr, lang), (held[1], fr, "fr")]), PATH).collect()}
        assert got[held[0]].lang_pred == "fr" and got[held[0]].score == got[held[1]].score


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in identify(frame(spark, [(1, "text", None)]), PATH).collect()] == ["und"]
    assert with_language(frame(spark, [(1, "text", None), (2, "1", None)]), PATH).count() == 1
    assert identify(frame(spark, []), PATH).count() == 0


def test_counts(spark):
    got = word_counts(frame(spark, [(1, "A a b1b", "x"), (2, "a", "x"), (3, "a", "y")]).select("lang", "text")).collect()
    assert {(r.lang, r.word): r.n for r in got} == {("x", "a"): 3, ("x", "b"): 2, ("y", "a"): 1}
    assert all(p.removeprefix("▁").isalpha() or p == "▁" for p in pieces(PATH))
