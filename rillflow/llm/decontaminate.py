"""Benchmark decontamination by spaced seeds: hash joins that tolerate substituted words, verified where they hit.

A seed looks at some of ``SPAN`` successive words and ignores the others. The masks are chosen so that whenever
``WINDOW`` aligned words of a document and a benchmark item agree in all but ``WINDOW - LEAST`` places, wherever those
are, some mask sees only agreeing words; a test tries all patterns. A hit is verified in the row it is found in, since
the benchmark side of the join carries the words around its seed. With few seeds these are broadcast and no text is
shuffled; with more, places and seeds are, and each text once, when the words around its hits are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table, texts

WINDOW, LEAST, SPAN = 15, 12, 9
MASKS = ((0, 1, 5, 7, 8), (0, 1, 6, 7, 8))
LEAD = WINDOW - SPAN            # words before a seed that a window around it may begin with
BROADCAST_SEEDS = 200_000       # seeds, about 400 bytes each, that may be broadcast


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; none of a null text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def hashed(listed: Column) -> Column:
    """Words as numbers, so that seeds are made of numbers alone."""
    return F.transform(listed, lambda word: F.xxhash64(word))


def seeds(at: Column, hashes: Column) -> Column:
    """One hash for each mask, over the words it looks at from position ``at`` on."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get(hashes, at + o) for o in mask]) for m, mask in enumerate(MASKS)])


def positions(listed: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.size(listed) - SPAN))


def around(at: Column, listed: Column) -> Column:
    """The words of all windows around a seed, those before the text as nulls."""
    missing = F.greatest(F.lit(0), LEAD - at)
    nothing = F.array_repeat(F.lit(None).cast("string"), missing)
    return F.concat(nothing, F.slice(listed, F.greatest(F.lit(0), at - LEAD) + 1, LEAD + WINDOW - missing))


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """(seed, item_id, near): every seed of every item, with the words of all windows around it."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"),
                             words(benchmark["text"]).alias("listed"))
    items = items.where(F.size("listed") >= SPAN).withColumn("hashes", hashed(F.col("listed")))
    items = items.select("item_id", "listed", "hashes", positions(F.col("listed")).alias("j"))
    near = around(F.col("j"), F.col("listed"))
    return items.select(F.explode(seeds(F.col("j"), F.col("hashes"))).alias("seed"), "item_id", near.alias("near"))


def shuffled_hits(sown: DataFrame, known: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, th, listed, i, item_id, near): hits of any number of seeds, by shuffles of numbers and of whole texts once.

    Copies of a text have the same hits, which are looked for once.
    """
    places = sown.select("th", "i", "seed").distinct()
    hits = places.join(known, "seed").select("th", "i", "item_id", "near").distinct()
    return listed.join(hits, "th")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, item_id, best_match): documents that share ``WINDOW`` aligned words with an item, up to
    ``WINDOW - LEAST`` substitutions.

    ``best_match`` is the largest number of equal words in such a window, ``th`` the hash of the document's text.
    Words beyond an end of either side count as different, so items and documents of fewer than ``LEAST`` words share
    nothing, null texts among them. Rows with null ids are reported under null. Repeated items and documents are
    reported once each. Either table may be empty.
    """
    known = benchmark_seeds(benchmark)
    few = known.count() <= BROADCAST_SEEDS
    listed = texts(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("listed"))
    placed = listed.where(F.size("listed") >= SPAN).withColumn("hashes", hashed(F.col("listed")))
    placed = placed.select("doc_id", "th", "listed", "hashes", positions(F.col("listed")).alias("i"))
    sown = placed.select("doc_id", "th", "listed", "i", F.explode(seeds(F.col("i"), F.col("hashes"))).alias("seed"))
    hits = sown.join(F.broadcast(known), "seed") if few else shuffled_hits(sown, known, listed)
    # Verified apart from the join, as together they would be more code than the JVM compiles. The generator is there
    # so that the words around the hit are cut out before that, and the text stays behind.
    hits = hits.select("doc_id", "th", "item_id", "near",
                       F.explode(F.array(around(F.col("i"), F.col("listed")))).alias("here"))
    same = F.zip_with("here", "near", lambda a, b: F.when(a == b, 1).otherwise(0))
    hits = hits.select("doc_id", "th", "item_id", same.alias("same"))
    total = lambda a: F.aggregate(F.slice("same", a, WINDOW), F.lit(0), lambda n, x: n + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(LEAD + 1)), total))
    found = hits.select("doc_id", "th", "item_id", best.alias("match")).where(F.col("match") >= LEAST)
    return found.groupBy("doc_id", "th", "item_id").agg(F.max("match").cast("long").alias("best_match"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the documents that leak an item."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_th"])
    return docs.join(gone, same, "left_anti")


SQL = r"""
WITH d AS (
    SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
    FROM documents),
b AS (
    SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
    FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b),
s AS (
    SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, i - j ORDER BY j
                                           RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) AS n
    FROM dw JOIN bw USING (word))
SELECT doc_id, item_id, max(n) AS best_match FROM s WHERE n >= 12 GROUP BY ALL"""


@query("op2_spaced_seeds", SQL)
def spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("best_match").alias("best_match"))
