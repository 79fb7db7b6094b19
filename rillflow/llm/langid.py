"""Language identification by unigram pieces, summed over all segmentations.

The pieces come from a fixed public vocabulary; each language has a probability for every piece. The probability of a
word is that of all ways to cut it into pieces, which a forward pass sums up; a text's is the product over its words.
Piece probabilities are learned by expectation-maximisation over the counts of all words of the training documents:
words are counted and the expected uses of pieces are summed by Spark, the driver sees one number per language and
piece.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, query, table, written

LETTERS = regex.compile(r"\p{L}+")
# the same for texts without characters beyond U+FFFF, by the standard module, which is faster at it
BASIC = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
BASIC_LETTERS = re.compile("[" + "".join(f"{run[0]}-{run[-1]}" for run in LETTERS.findall(BASIC)) + "]+")
BEYOND = re.compile("[\U00010000-\U0010FFFF]")
START = "▁"                # stands before a word's first letter in the vocabulary
TABLED = 41                     # characters of a word that is worked on with others of its length
STEP = 2.0 ** 24                # sums over cuts of n characters are held STEP**n times as large: at most 2**984
SMALL = 1e-290                  # a smaller sum may have lost digits; its text is worked on in logs
CHARS = 30_000                  # characters of words that are worked on together
COUNTED, SCORED = 100_000, 100_000      # words that a task counts, and a worker scores, before it lets go of them
ROWS = 500                      # documents whose words are scored at once
SMOOTH = 0.01


def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters, in lower case, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).lower()
            if piece == START or piece.removeprefix(START).isalpha():
                found.add(piece)
    return {piece: i for i, piece in enumerate(sorted(found))}


class Prefixes:
    """All beginnings of the pieces as the nodes of a tree, whose steps by a letter are looked up for many texts at once."""

    def __init__(self, vocabulary: dict[str, int]):
        nodes = {prefix: k for k, prefix in enumerate({"": 0} | {s[:i]: 0 for s in vocabulary for i in range(1, len(s) + 1)})}
        steps = list(nodes)[1:]
        letters = np.array([ord(s[-1]) for s in steps], dtype=np.int64)
        self.alphabet, letters = np.unique(letters, return_inverse=True)
        self.pieces = np.full(len(nodes), -1, dtype=np.int32)
        self.pieces[[nodes[s] for s in vocabulary]] = list(vocabulary.values())
        keys = np.array([nodes[s[:-1]] for s in steps], dtype=np.int64) * len(self.alphabet) + letters
        self.shift = 64 - max(4, 2 + int(len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << (64 - self.shift), -1, dtype=np.int64), np.zeros(1 << (64 - self.shift), np.int32)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            taken, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.keys[taken], self.nodes[taken] = keys[put], put + 1
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the letters, minus one for such as are in no piece."""
        if not len(self.alphabet):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, -1)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node that each letter, which must be in a piece, leads to from each node, or minus one."""
        keys = nodes * len(self.alphabet) + letters
        at = self.place(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.nodes[at], -1)
        missed = np.flatnonzero((met != keys) & (met >= 0))
        while len(missed):
            at[missed] = (at[missed] + 1) & (len(self.keys) - 1)
            met = self.keys[at[missed]]
            hit = met == keys[missed]
            out[missed[hit]] = self.nodes[at[missed[hit]]]
            missed = missed[~hit & (met >= 0)]
        return out


class Cuts:
    """The pieces that texts can be cut into, as steps between places: a text of n characters has n + 1 places.

    Steps are in groups by the end and then the start within the text, so that no place occurs twice in a group's starts
    or in its ends, and sums over cuts are taken in the order of the text.
    """

    def __init__(self, texts: list[str], lattice: Lattice):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last, self.places = self.first + sizes, int((sizes + 1).sum())
        letters = np.full(self.places + lattice.longest, -1)        # a place stands for the letter that follows it
        inner = np.delete(np.arange(self.places), self.last)
        letters[inner] = lattice.prefixes.letters(np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"))
        place = inner - np.repeat(self.first, sizes)                # within the text
        at, nodes = np.arange(len(inner)), np.zeros(len(inner), dtype=np.int64)
        found = []
        for n in range(1, lattice.longest + 1):
            here = letters[inner[at] + n - 1]
            known = here >= 0
            at, nodes = at[known], lattice.prefixes.step(nodes[known], here[known])
            at, nodes = at[nodes >= 0], nodes[nodes >= 0].astype(np.int64)
            pieces = lattice.prefixes.pieces[nodes]
            whole = pieces >= 0
            if n == 1:
                every = np.full(len(inner), lattice.unknown, dtype=np.int32)
                every[at[whole]] = pieces[whole]
                found.append((np.arange(len(inner)), every, n))
            else:
                found.append((at[whole], pieces[whole], n))
        at = np.concatenate([x for x, _, _ in found])
        self.pieces = np.concatenate([x for _, x, _ in found])
        size = np.repeat([n for _, _, n in found], [len(x) for x, _, _ in found])
        group = (place[at] + size) * (lattice.longest + 1) + lattice.longest - size
        order = np.argsort(group.astype(np.int16) if len(group) and group.max() < 1 << 15 else group, kind="stable")
        self.starts, self.ends, self.pieces = inner[at[order]], (inner[at] + size)[order], self.pieces[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]]).tolist()
        self.groups = [slice(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]

    def ahead(self, weights: np.ndarray) -> np.ndarray:
        """Forward sums at each place; ``weights`` has a row for each step."""
        ahead = np.zeros((self.places, *weights.shape[1:]))
        ahead[self.first] = 1
        for these in self.groups:
            ahead[self.ends[these]] += ahead[self.starts[these]] * weights[these]
        return ahead

    def behind(self, weights: np.ndarray) -> np.ndarray:
        behind = np.zeros(self.places)
        behind[self.last] = 1
        for these in reversed(self.groups):
            behind[self.starts[these]] += behind[self.ends[these]] * weights[these]
        return behind

    def low(self, ahead: np.ndarray) -> np.ndarray:
        """Which texts have a sum that may have lost digits."""
        least = ahead if ahead.ndim == 1 else ahead.min(axis=1, initial=np.inf)
        return np.minimum.reduceat(least, self.first) < SMALL


class Lattice:
    """All segmentations of words; the last two piece numbers are an unknown letter and no piece at all."""

    def __init__(self, vocabulary: dict[str, int]):
        self.ids, self.unknown = vocabulary, len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        self.sizes = np.ones(len(vocabulary) + 2)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.prefixes = Prefixes(vocabulary)

    def scaled(self, p: np.ndarray) -> np.ndarray:
        """``p``, with a row for each piece, times ``STEP`` for each character: no sum over cuts exceeds ``STEP**n``."""
        return p * (STEP ** self.sizes).reshape(-1, *[1] * (p.ndim - 1))

    def score(self, texts: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each text in each language; ``p`` has a row for each piece."""
        out, weights, logs = np.empty((len(texts), p.shape[1])), self.scaled(p), log(p)
        long, parts = portions(texts)
        for k in long:
            out[k] = self.long_score(texts[k], p, logs)
        for where in parts:
            same = [texts[w] for w in where]
            cuts = Cuts(same, self)
            ahead = cuts.ahead(weights[cuts.pieces])
            found = log(ahead[cuts.last]) - (cuts.last - cuts.first)[:, None] * np.log(STEP)
            for k in np.flatnonzero(cuts.low(ahead)):
                found[k] = self.long_score(same[k], p, logs)
            out[where] = found
        return out

    def long_score(self, s: str, p: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
        """The same for one text of any length, by logs of the sums, of which only the last few are kept."""
        logs = log(p) if logs is None else logs
        recent = [np.zeros(p.shape[1])]
        for j in range(1, len(s) + 1):
            ways = []
            for back, ahead in enumerate(reversed(recent), 1):
                piece = self.ids.get(s[j - back:j], self.unknown if back == 1 else None)
                if piece is not None:
                    ways.append(ahead + logs[piece])
            now = np.logaddexp.reduce(ways)
            recent = [*recent[1 - self.longest:], now] if self.longest > 1 else [now]
        return recent[-1]

    def expect(self, texts: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``n`` copies of each text, under the probabilities ``p`` of one language."""
        uses, weights, logs = np.zeros(len(p)), self.scaled(p), log(p)
        long, parts = portions(texts)
        for k in long:
            self.long_expect(texts[k], n[k], logs, uses)
        for where in parts:
            same = [texts[w] for w in where]
            cuts = Cuts(same, self)
            weight = weights[cuts.pieces]
            ahead, behind = cuts.ahead(weight), cuts.behind(weight)
            low = cuts.low(ahead)
            for k in np.flatnonzero(low):
                self.long_expect(same[k], n[where[k]], logs, uses)
            whole = np.where(low, 0.0, n[where]) / np.where(low, 1.0, ahead[cuts.last])
            share = weight * ahead[cuts.starts] * behind[cuts.ends]
            share *= np.repeat(whole, cuts.last - cuts.first + 1)[cuts.starts]
            uses += np.bincount(cuts.pieces, share, minlength=len(p))
        return uses

    def long_expect(self, s: str, n: float, logs: np.ndarray, uses: np.ndarray) -> None:
        """Adds the same for one text of any length to ``uses``, by logs of the sums."""
        cuts, ahead = [], np.full(len(s) + 1, -np.inf)
        ahead[0] = 0
        for j in range(1, len(s) + 1):
            met = [(i, self.ids.get(s[i:j], self.unknown if i == j - 1 else None))
                   for i in range(max(0, j - self.longest), j)]
            met = [(i, piece) for i, piece in met if piece is not None]
            starts, found = (np.array(x) for x in zip(*met))
            cuts.append((starts, found))
            ahead[j] = np.logaddexp.reduce(ahead[starts] + logs[found])
        behind = np.full(len(s) + 1, -np.inf)
        behind[-1] = 0
        for j in range(len(s), 0, -1):
            starts, found = cuts[j - 1]
            after = logs[found] + behind[j]
            np.add.at(uses, found, n * np.exp(ahead[starts] + after - ahead[-1]))
            behind[starts] = np.logaddexp(behind[starts], after)


def log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def portions(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The texts of more than ``TABLED`` characters, and the others in parts of some ``CHARS`` characters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    short = np.flatnonzero(sizes <= TABLED)
    part = np.cumsum(sizes[short]) // CHARS
    return np.flatnonzero(sizes > TABLED), np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else []


def letter_runs(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (LETTERS if BEYOND.search(text) else BASIC_LETTERS).findall(text)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all of (lang, text)."""

    def run(batches: Batches) -> Batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[lang].update(letter_runs(text.as_py()))
                if sum(map(len, counts.values())) > COUNTED:
                    yield from rows(counts)
                    counts.clear()
        yield from rows(counts)

    def rows(counts):
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.string()),
                pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    met = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return met.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame, vocabulary: dict[str, int], rounds: int) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities with a column for each)."""
    lattice = Lattice(vocabulary)
    size = len(vocabulary) + 2
    model: dict[str, np.ndarray] = {}
    flat = np.full(size, 1 / (size - 1))
    flat[-1] = 0

    def expect(batches: Batches) -> Batches:
        uses: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        for batch in batches:
            met = defaultdict(lambda: ([], []))
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                met[lang][0].append(START + word)
                met[lang][1].append(n)
            for lang, (words, n) in met.items():
                uses[lang] += lattice.expect(words, np.array(n, dtype=np.float64), model.get(lang, flat))
        for lang, found in uses.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at),
                                              pa.array(found[at])], ["lang", "piece", "uses"])

    for _ in range(rounds):
        used = counts.mapInArrow(expect, "lang string, piece long, uses double")
        summed = used.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect()   # languages times pieces
        model = {}
        for row in summed:
            model.setdefault(row["lang"], np.zeros(size))[row["piece"]] = row["uses"]
        for lang, uses in model.items():
            p = (uses + SMOOTH) / (uses.sum() + SMOOTH * (size - 1))
            p[-1] = 0
            model[lang] = p
    langs = sorted(model)
    return langs, np.stack([model[x] for x in langs], axis=1) if langs else np.zeros((size, 0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def slices(batches: Batches) -> Batches:
    """Batches of at most ``ROWS`` rows: the numbers of all words of a batch are held at once."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


class Numbers(dict):
    """Words by the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Guesser:
    """Language and its probability for texts; a worker scores a word once while it remembers it."""

    def __init__(self, vocabulary: dict[str, int], langs: list[str], p: np.ndarray):
        self.lattice, self.langs, self.p = Lattice(vocabulary), langs, p
        self.rows, self.scores = Numbers(), np.empty((0, len(langs)))

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        if len(self.rows) > SCORED:
            self.rows, self.scores = Numbers(), self.scores[:0]
        known, found = len(self.rows), []
        for text in texts:
            words = letter_runs(text.as_py()) if self.langs else []
            found.append(np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words)))
        new = [START + w for w in islice(self.rows, known, None)]
        self.scores = np.concatenate([self.scores, self.lattice.score(new, self.p)])
        best, sure = [], []
        for at in found:
            if not len(at):
                best.append("und")
                sure.append(0.0)
                continue
            total = self.scores[at].sum(axis=0)
            top = int(total.argmax())
            best.append(self.langs[top])
            sure.append(float(1 / np.exp(total - total[top]).sum()))
        return best, sure


def trained(docs: DataFrame, vocabulary_path: str, rounds: int):
    """The model learned from (doc_id, text, lang), broadcast: its size is that of vocabulary times languages."""
    train = docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull()
                       & F.col("text").isNotNull())
    vocabulary = pieces(vocabulary_path)
    langs, p = learn(written(word_counts(train), "words"), vocabulary, rounds)
    return docs.sparkSession.sparkContext.broadcast((vocabulary, langs, p))


def identify(docs: DataFrame, vocabulary_path: str, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Learns from the rows with an id, a text and a language whose id's checksum is no multiple of five; ids are used
    for nothing else. ``score`` is the probability of the language among all learned ones, which start out equal;
    ties go to the language that comes first by name. Texts that are null or hold no letter are ``und`` with score 0,
    and so is every text if there is nothing to learn from. Null ids are never learned from and are not held out.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       docs[lang_col].cast("string").alias("lang"))
    shared = trained(docs, vocabulary_path, rounds)

    def predict(batches: Batches) -> Batches:
        guess = Guesser(*shared.value)
        for batch in slices(batches):
            best, sure = guess(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()),
                                              pa.array(sure, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, vocabulary_path: str, least: float = 0.5, rounds: int = 2) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...), unchanged, whose text is in a learned language.

    Rejected are texts without a letter and those whose best language has a probability below ``least``. Where nothing
    could be learned no row is rejected for its language, only for having no letter.
    """
    shared = trained(docs.select(docs["doc_id"].cast("long"), docs["text"], docs["lang"]), vocabulary_path, rounds)

    def keep(batches: Batches) -> Batches:
        guess = Guesser(*shared.value)
        for batch in slices(batches):
            text = batch.column("text")
            if guess.langs:
                best, sure = guess(text)
                fine = [b != "und" and s >= least for b, s in zip(best, sure)]
            else:
                fine = [bool(letter_runs(x.as_py())) for x in text]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


@query("op8_marginal_unigrams")
def marginal_unigrams(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
