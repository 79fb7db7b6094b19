"""Concatenate and cut: token streams of all documents end to end, cut into fixed windows.

The first pass tokenises each input partition and writes its ids with their offsets inside the partition. The totals
of the partitions, summed up in order, turn those into global offsets; the second pass cuts each document at the
window borders it crosses. No row is shuffled, and what depends on all data is one number for each partition.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, query, table, texts, written

CACHED_WORDS = 150_000          # encoded words of about 200 bytes that a worker gathers, and as many from before that
# letters that the tokenizer's normalisation leaves alone, then marks: no apostrophe, and none that special tokens hold
RUN = re.compile(r"""([a-zß-öø-ÿ]+)([!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)""")
END = "</w>"                    # closes the last token of a run of letters in the vocabulary

STREAM = "part int, place long, doc_id long, start long, n long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, boundary boolean, ids binary")


@lru_cache(maxsize=1)
def encoder(path: str):
    """A function from texts to little-endian ids, one for all tasks of a worker.

    This tokenizer lower-cases, drops white space and lets no token cross it, nor cross from a letter to a mark. So a
    text's ids are those of its words in order, and a worker encodes a word once while it remembers it, the marks
    that end it apart. Special tokens in a text keep their own ids; as case matters to them, a text that may hold
    one is not lower-cased beforehand.

    Letters of ``RUN`` are the same after the tokenizer's normalisation, so new words of them alone are encoded as one
    text without it. Each is one run for the tokenizer, and the token that ends a run says so: the ids are cut there.
    All other words are encoded singly, with every step of the tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer.from_file(path)
    light = Tokenizer(model.model)      # the same vocabulary and merges, held once
    light.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    known, before = {}, {}              # encoded words; when there are many, those not met again go with the next change
    ends = np.zeros(model.get_vocab_size(), dtype=bool)
    ends[[i for token, i in model.get_vocab().items() if token.endswith(END)]] = True

    def together(words: list[bytes]) -> bool:
        joined = b" ".join(words).decode()
        ids = np.array(light.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(words):
            return False
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        known.update(zip(words, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        return True

    def learn(words: set[bytes]) -> None:
        plain, other, marked = set(), set(), []
        for word in words:
            if word in before:
                known[word] = before[word]
                continue
            run = RUN.fullmatch(word.decode())
            if run is None:
                other.add(word)
            elif run[2]:
                stem, marks = word[:-len(run[2])], word[-len(run[2]):]
                plain.add(stem)
                other.add(marks)
                marked.append((word, stem, marks))
            else:
                plain.add(word)
        plain, other = [w for w in plain if w not in known], [w for w in other if w not in known]
        if plain and not together(plain):
            other += plain
        for word, got in zip(other, model.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            known[word] = array("I", got.ids).tobytes()
        for word, stem, marks in marked:
            known[word] = known[stem] + known[marks]

    def encode(text: str | None) -> bytes:
        nonlocal known, before
        data = (text or "").encode()
        words = data.split() if b"<|" in data else data.lower().split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHED_WORDS:
                known, before = {}, known
            learn({w for w in words if w not in known})
            return b"".join([known[w] for w in words])

    return encode


def token_stream(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: each document's ids, closed by ``end_id``, and its offset inside its partition."""

    def run(batches: Batches) -> Batches:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, at, place = np.array([end_id], dtype="<u4").tobytes(), 0, 0
        for batch in batches:
            # ids leave in slices, so that a batch of very long texts is never held as one
            ids, keys, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encode(text.as_py()) + end)
                keys.append(key)
                size += len(ids[-1])
                if size > 16 << 20:
                    yield rows(part, place, keys, at, ids)
                    place, at, ids, keys, size = place + len(ids), at + size // 4, [], [], 0
            if ids:
                yield rows(part, place, keys, at, ids)
                place, at = place + len(ids), at + size // 4

    def rows(part, place, keys, at, ids) -> pa.RecordBatch:
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(np.arange(place, place + len(ids))),
            pa.array(keys, pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary()),
        ], ["part", "place", "doc_id", "start", "n", "ids"])

    return docs.mapInArrow(run, STREAM)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, in sequences of ``window`` tokens.

    Columns: ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` over the ids as
    little-endian 32-bit numbers, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, ``boundary`` (the piece
    ends its document, so that attention must not pass), and ``ids`` (null unless asked for). Every sequence but the
    last is full.

    Null and empty texts give just the end id. Null and repeated ids are packed like others, each row for itself. An
    empty table gives no rows.
    """
    stream = written(token_stream(texts(docs, id_col, text_col), tokenizer, end_id), "stream")
    totals = stream.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row of 16 bytes for each partition of the input: a few MB at 100 TB, so it may be broadcast
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = stream.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            at, n = (batch.column(i).to_numpy() for i in (1, 2))
            first = at // window
            pieces = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(batch)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * window - at[row], 0)
            end = np.minimum((sequence + 1) * window - at[row], n[row])
            texts = [memoryview(x.as_buffer()) for x in batch.column(3)]
            cuts = [texts[k][4 * a:4 * b] for k, a, b in zip(row.tolist(), start.tolist(), end.tolist())]
            columns = [batch.column(0).take(pa.array(row)), start, end - start, [zlib.crc32(x) for x in cuts], n[row],
                       sequence, (at[row] + start) % window, end == n[row],
                       [x.tobytes() if with_ids else None for x in cuts]]
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)],
                                             [c.split()[0] for c in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)


@query("op9_concat_and_cut")
def concat_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("ids", "boundary")
