"""How far the sources of a language diverge in their words: a recount over perfect hashes.

The first pass counts in how many documents of its language each term occurs, exactly, and keeps the frequent ones.
Kept terms are placed by minimal perfect hashes, built on executors in shards of a language. The most frequent terms, up
to a bound, are broadcast with their stored terms; the second pass looks every word up there and increments the dense
slots of its group. Words of the other kept terms, if the bound leaves any, are counted by name and joined to their
slots. Shares and distances are whole numbers throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, BitFilter, query, table, written
from .perfect_hash import PerfectHashes, build, term_hash

LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))   # bytes of terms stay, others part them
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c for c in LETTERS)
CHUNK = 1 << 20                 # bytes of a text that are cut into terms at once
HELD = 64 << 20                 # bytes of counts that a task holds before it passes them on
WORDS = 400_000                 # words looked up at once
SHARD = 4096                    # terms in a shard, on average
TILE = 256                      # sources in a tile of the distances, on average
BROADCAST_TERMS, BROADCAST_BYTES = 1 << 20, 64      # what may be broadcast: so many terms, none longer than this
SMOOTHING, SCALE = 5, 1000      # added to each count; shares are in units of 1 / SCALE ** 3


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order: letters of ASCII, in lower case, and whatever is not ASCII. Long texts in parts."""
    clean, at = raw.translate(CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + CHUNK)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _grouped(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(docs[c].cast("string"), empty).alias(c) for c in ("lang", "source")],
                       F.coalesce(docs["text"].cast("string"), empty).cast("binary").alias("text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many rows of its language each term occurs."""

    def flush(seen: dict[str, Counter]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, found in seen.items() for _ in found], pa.string()),
             pa.array([t for found in seen.values() for t in found], pa.binary()),
             pa.array([n for found in seen.values() for n in found.values()], pa.int64())], ["lang", "term", "docs"])

    def run(batches: Batches) -> Batches:
        seen, held = {}, 0
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms: set[bytes] = set()
                for part in term_lists(raw.as_py()):
                    terms.update(part)
                counts = seen.setdefault(lang, Counter())
                new = [t for t in terms if t not in counts]
                held += 150 * len(new) + sum(map(len, new))
                counts.update(terms)
                if held > HELD:
                    yield flush(seen)
                    seen, held = {}, 0
        if seen:
            yield flush(seen)

    found = rows.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")
    return found.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("docs").alias("docs"))


SHARDS = "lang string, tier int, shard int, shards int, sizes array<int>, bits binary, keys array<binary>, placed int, terms int"


def perfect_hashes(kept: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """The shards over ``kept`` (lang, term, docs): tier 0 holds at most ``most`` terms, the most frequent, tier 1 the rest.

    Tier 0 begins at a power of two of the document frequency, so that the bound needs no sorting.
    """
    bits, short = F.length(F.bin("docs")), F.octet_length("term") <= BROADCAST_BYTES
    total, least = 0, 64
    for row in kept.where(short).groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect():   # 63 rows at most
        total += row["count"]
        if total > most:
            break
        least = row["bits"]
    tiers = kept.select("lang", "term", F.when(short & (bits >= least), 0).otherwise(1).alias("tier"))
    parts = tiers.groupBy("lang", "tier").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    shard = F.pmod(F.shiftrightunsigned(F.xxhash64("term"), 32), F.col("shards")).cast("int")
    dealt = tiers.join(parts, ["lang", "tier"]).select("lang", "tier", shard.alias("shard"), "shards",
                                                       F.col("term").cast("binary").alias("term"))

    def place(key, group):
        terms = sorted(group.column("term").to_pylist())
        sizes, bitmaps, keys, placed = build(terms, np.array([term_hash(t) for t in terms], dtype=np.uint64))
        row = [*(k.as_py() for k in key), group.column("shards")[0].as_py(), sizes, bitmaps, keys, placed, len(keys)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(),
                 pa.list_(pa.binary()), pa.int32(), pa.int32()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[f.split()[0] for f in SHARDS.split(", ")])

    return dealt.groupBy("lang", "tier", "shard").applyInArrow(place, SHARDS)


RECOUNT = "lang string, source string, shard int, slots array<int>, terms array<binary>, counts array<long>"


def recount(rows: DataFrame, shared, others: BitFilter | None) -> DataFrame:
    """The second pass: slots and counts by group and shard, and counts by term for what ``others`` lets through."""

    def count(hashes: PerfectHashes, lang: str, words: list[bytes], sources: list[str], lengths: list[int], dense, rest):
        coded = pa.array(words, pa.binary()).dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy()
        digests = np.fromiter(map(term_hash, terms.to_pylist()), dtype=np.uint64, count=len(terms))
        low, width = hashes.slots_of(lang)
        slots = hashes.lookup(lang, terms, digests)
        names = sorted(set(sources))
        number = {name: at for at, name in enumerate(names)}
        group = np.repeat(np.array([number[s] for s in sources], dtype=np.int64), lengths)
        of_word, held = slots[codes], 0
        known = of_word >= 0
        cells, counts = np.unique(group[known] * max(width, 1) + of_word[known] - low, return_counts=True)
        edges = np.searchsorted(cells, np.arange(len(names) + 1) * max(width, 1))
        for at, name in enumerate(names):
            if edges[at] < edges[at + 1]:
                if (lang, name) not in dense:
                    dense[lang, name] = np.zeros(width, dtype=np.int64)
                    held += 8 * width
                mine = slice(edges[at], edges[at + 1])
                dense[lang, name][cells[mine] - at * width] += counts[mine]
        if others is not None:
            open_ = np.zeros(len(terms), dtype=bool)
            open_[slots < 0] = others(digests[slots < 0])
            left = open_[codes]
            cells, counts = np.unique(group[left] * len(terms) + codes[left], return_counts=True)
            for cell, n in zip(cells.tolist(), counts.tolist()):
                name, term = names[cell // len(terms)], terms[cell % len(terms)].as_py()
                found = rest.setdefault((lang, name), {})
                held += 0 if term in found else 150 + len(term)
                found[term] = found.get(term, 0) + n
        return held

    def flush(hashes: PerfectHashes, dense, rest) -> pa.RecordBatch:
        out: list[tuple] = []
        for (lang, source), counts in dense.items():
            low, _ = hashes.slots_of(lang)
            slots = np.flatnonzero(counts)
            shards, places = hashes.shard_of(slots + low)
            for shard in np.unique(shards):
                mine = shards == shard
                number = int(shard) - hashes.of[lang][0]
                out.append((lang, source, number, places[mine].astype(np.int32), None, counts[slots[mine]]))
        for (lang, source), found in rest.items():
            out.append((lang, source, None, None, list(found), list(found.values())))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          [f.split()[0] for f in RECOUNT.split(", ")])

    def run(batches: Batches) -> Batches:
        hashes, dense, rest, held = shared.value, {}, {}, 0
        waiting, n = {}, 0

        def settle() -> int:
            grown = sum(count(hashes, lang, *lists, dense, rest) for lang, lists in waiting.items())
            waiting.clear()
            return grown

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for part in term_lists(raw.as_py()):
                    words, sources, lengths = waiting.setdefault(lang, ([], [], []))
                    words += part
                    sources.append(source)
                    lengths.append(len(part))
                    n += len(part)
                    if n >= WORDS:
                        held, n = held + settle(), 0
                        if held > HELD:
                            yield flush(hashes, dense, rest)
                            dense, rest, held = {}, {}, 0
        settle()
        if dense or rest:
            yield flush(hashes, dense, rest)

    return rows.mapInArrow(run, RECOUNT)


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(10 ** 9 * count / whole), digit by digit so that nothing leaves 64 bits; count is at most whole."""
    total, left = F.lit(1).cast("long"), count
    for digit in (SCALE ** 2, SCALE, 1):
        up = left * SCALE
        left = up % whole
        total = total + F.call_function("div", up, whole) * digit
    return total


def _shares(counts: np.ndarray, whole: int) -> np.ndarray:
    total, left = np.ones_like(counts), counts + SMOOTHING
    for digit in (SCALE ** 2, SCALE, 1):
        up, left = np.divmod(left * SCALE, whole)
        total = total + up * digit
    return total


def pair_distances(groups: DataFrame, shards: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the sum of their differences over all kept terms.

    A task holds the shares of two tiles of sources over one shard of terms, whatever the language's size.
    """
    packed = counts.groupBy("lang", "tier", "shard", "source").agg(F.collect_list(F.struct("slot", "n")).alias("found"))
    none = groups.where("v = 0").select("lang").distinct().select(
        "lang", F.lit(0).alias("tier"), F.lit(0).alias("shard"), F.lit(0).alias("terms"))
    blocks = shards.select("lang", "tier", "shard", "terms").unionByName(none)
    tiles = F.ceil(F.col("sources") / TILE)
    rows = groups.select("lang", "source", "whole", F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"),
                         F.sequence(F.lit(0), (tiles - 1).cast("int")).alias("tiles"))
    rows = rows.join(blocks, "lang").join(packed, ["lang", "tier", "shard", "source"], "left")
    rows = rows.withColumn("other", F.explode("tiles")).select(
        "lang", "tier", "shard", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"),
        "tile", "source", "whole", "terms", "found")

    def distances(key, group):
        lang, _, _, one, two = (k.as_py() for k in key)
        group = group.sort_by("source")
        tile, names = group.column("tile").to_numpy(), group.column("source").to_pylist()
        shares = np.zeros((len(names), group.column("terms")[0].as_py()), dtype=np.int64)
        for at, (found, whole) in enumerate(zip(group.column("found").to_pylist(), group.column("whole").to_pylist())):
            for x in found or ():
                shares[at, x["slot"]] = x["n"]
            if whole:
                shares[at] = _shares(shares[at], whole)
        left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
        out: list[tuple] = []
        for at in left:
            others = right[right > at] if one == two else right
            values = np.abs(shares[others] - shares[at]).sum(axis=1)
            out += [(lang, names[at], names[b], v) for b, v in zip(others.tolist(), values.tolist())]
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "value"])

    schema = "lang string, source string, item string, value long"
    found = rows.groupBy("lang", "tier", "shard", "one", "two").applyInArrow(distances, schema)
    once = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"),
                                                                   F.col("source").alias("item"))))
    return once.select("lang", sides.alias("side"), "value").select("lang", "side.source", "side.item", "value")


def term_distances(groups: DataFrame, terms: DataFrame, counts: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source holds more of than its language, the first ``ranks``."""
    sizes = groups.groupBy("lang").agg((F.sum("n") + SMOOTHING * F.first("v")).alias("lang_whole"))
    slot = ["lang", "tier", "shard", "slot"]
    known = counts.groupBy(*slot).agg(F.sum("n").alias("lang_n")).join(terms, slot).join(sizes, "lang")
    known = known.select(*slot, "item", _share(F.col("lang_n") + SMOOTHING, F.col("lang_whole")).alias("q"))
    own = counts.join(groups.select("lang", "source", "whole"), ["lang", "source"]).join(known, slot)
    value = _share(F.col("n") + SMOOTHING, F.col("whole")) - F.col("q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = own.select("lang", "source", "item", value.alias("value")).where("value > 0")
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


def divergence(docs: DataFrame, least_docs: int = 30, ranks: int = 50, most: int = BROADCAST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) from documents (lang, source, text); null columns count as empty texts.

    A language keeps the terms that occur in ``least_docs`` of its rows or more. A group is a language and a source; its
    share of a kept term is 1 + floor(10 ** 9 * (count + 5) / (all counts + 5 * kept terms)), a language's share
    likewise. Part ``pair`` gives for each other source of the language the sum of the differences of shares over all
    kept terms, 0 if there are none; part ``term`` the kept terms of the group with a share above the language's, by
    that difference, up to rank ``ranks``. Ranks go by value, descending, then by item in order of UTF-8, from 1.

    Repeated rows count each time. A language with one source has no pairs, a text without terms adds its group only,
    no rows give no rows. Other columns are not looked at. ``most`` bounds the terms that are broadcast (at most 64 bytes
    each) and changes no result. Counts may reach 9 * 10 ** 15 words a language.
    """
    spark, rows = docs.sparkSession, _grouped(docs)
    kept = written(document_frequencies(rows).where(F.col("docs") >= least_docs), "kept")
    shards = written(perfect_hashes(kept, most), "shards")
    columns = [F.col("lang").alias("name"), "shard", "shards", "sizes", "bits", "keys", "placed"]
    shared = spark.sparkContext.broadcast(PerfectHashes(shards.where("tier = 0").select(*columns).toArrow()))
    terms = shards.select("lang", "tier", "shard", F.posexplode("keys").alias("slot", "item"))
    terms = written(terms.withColumn("item", F.col("item").cast("string")), "terms")
    rest = terms.where("tier = 1")
    others = None if rest.isEmpty() else BitFilter(spark, rest.select(F.xxhash64("item").alias("h")))

    found = written(recount(rows, shared, others), "recounted")
    each = F.explode(F.arrays_zip("slots", "counts")).alias("x")
    counts = found.where("shard is not null").select(
        "lang", "source", F.lit(0).alias("tier"), "shard", each).select(
        "lang", "source", "tier", "shard", F.col("x.slots").alias("slot"), F.col("x.counts").alias("n"))
    counts = counts.groupBy("lang", "source", "tier", "shard", "slot").agg(F.sum("n").alias("n"))
    if others is not None:
        named = found.where("shard is null").select("lang", "source", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        named = named.groupBy("lang", "source", F.col("x.terms").cast("string").alias("item")).agg(
            F.sum("x.counts").alias("n"))
        counts = counts.unionByName(named.join(rest, ["lang", "item"]).select(*counts.columns))
    counts = written(counts, "counts")

    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left")
    groups = groups.na.fill(0, ["n", "v"]).withColumn("whole", F.col("n") + SMOOTHING * F.col("v"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = written(groups.join(sources, "lang"), "groups")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(groups, shards, counts).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        term_distances(groups, terms, counts, ranks).withColumn("part", F.lit("term")).select(*columns))


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d),
kept AS (SELECT lang, item FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, item, count(*) AS n FROM w JOIN kept USING (lang, item) GROUP BY ALL),
g AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
l AS (SELECT lang, first(v) AS v, sum(n) AS n FROM g GROUP BY lang),
p AS (
    SELECT lang, source, item, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * g.v) AS p
    FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, item)),
q AS (
    SELECT lang, item, 1 + (1000000000 * (t.n + 5)::HUGEINT) // (l.n + 5 * l.v) AS q
    FROM (SELECT lang, item, sum(n) AS n FROM c GROUP BY ALL) t JOIN l USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f
               FROM p x JOIN p y ON x.lang = y.lang AND x.item = y.item AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
terms AS (SELECT lang, source, item, p - q AS value FROM p JOIN q USING (lang, item) WHERE n > 0 AND p > q),
ranked AS (
    SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op11_source_divergence", SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))
