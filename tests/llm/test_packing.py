"""Packing against direct tokenisation."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rillflow.llm.packing import encoder, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids int, part string, start string, n long"


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def ids_of(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "a", "B", "é", "É", "ß", "İ", "Σ", "ς", " ", "\t", "\n", "\x0b", "\x1c", "\x85", " ", "'s", "'LL", ",", ".", "!", "..",
    "<|endoftext|>", "<|ENDOFTEXT|>", "1", "٣", "漢", "é", "word", "don't"])).map("".join))
def test_word_by_word_is_the_whole_text(text):
    model = Tokenizer.from_file(PATH)
    got = np.frombuffer(encoder(PATH)(text), dtype="<u4").tolist()
    assert got == model.encode(text, add_special_tokens=False).ids


def test_most_words_need_no_whole_tokenizer(model):
    text = "Word word, straße. élan!! thti,%%% 12. don't \"a\" <|endoftext|>.. ab***"
    singly = []
    encode = encoder.__wrapped__(PATH)
    cells = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__)))
    learned = dict(zip(cells["learn"].__code__.co_freevars, cells["learn"].__closure__))

    class Seen:
        def encode_batch_fast(self, words, **kw):
            singly.extend(words)
            return model.encode_batch_fast(words, **kw)

    learned["model"].cell_contents = Seen()
    plain = text.replace("<|endoftext|>", "x")
    assert np.frombuffer(encode(plain), dtype="<u4").tolist() == model.encode(plain, add_special_tokens=False).ids
    assert set(singly) == {",", ".", "!!", ",%%%", "12.", "don't", '"a"', "..", "***"}
    assert np.frombuffer(encode(text), dtype="<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_words_of_the_generation_before_are_not_encoded_again(model, monkeypatch):
    monkeypatch.setattr("rillflow.llm.packing.CACHED_WORDS", 2)
    encode = encoder.__wrapped__(PATH)
    for text in ("a b c, a", "d e b 12", "a c, f!! b", "12 g a", "b e d c,", "", "a b c, d e f!! 12 g"):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def check(model, rows, texts, window):
    docs = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    taken = sorted((r.sequence_id * window + r.offset, r.length) for r in rows)
    at = 0
    for start, length in taken:                     # gapless, nothing twice
        assert start == at and length > 0
        at += length
    assert at == sum(len(ids_of(model, t)) for _, t in texts)
    assert all(r.offset + r.length <= window for r in rows)
    left = sorted((i, len(ids_of(model, t)), t or "") for i, t in texts if i is not None)
    for doc, n, text in left:
        ids = np.array(ids_of(model, text), dtype="<u4")
        pieces = [r for r in docs[doc, n] if zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32]
        assert {x for r in pieces for x in range(r.start, r.start + r.length)} == set(range(n))
        assert sum(r.boundary for r in pieces) >= 1


def test_whole_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check(model, pack(docs.repartition(3), PATH).collect(), texts, 2048)


def test_odd_rows(spark, model):
    texts = [(1, "One two three."), (2, None), (3, ""), (None, "no id"), (1, "One two three."), (4, "word " * 30000),
             (5, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, None, "p", "s", 9) for i, t in texts], SCHEMA).repartition(2)
    rows = pack(docs, PATH, window=64, with_ids=True).collect()
    check(model, rows, texts, 64)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert [r.doc_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
