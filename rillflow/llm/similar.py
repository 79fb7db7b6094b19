"""Near-duplicates by exact Jaccard similarity of shingle sets: the grid of fingerprints, a prefix join, verification.

The grid of ``simhash_grid`` comes first: sets whose fingerprints differ in few bits are compared whole and linked. At a
similarity of 0.8 most pairs differ in more bits than a grid can have cells for, so a prefix join that misses no pair
looks for links between what the grid has not brought together.

Order all shingles in one way everywhere. Of two sets with similarity ``least`` or more, the first
``n - ceil(least * n) + 1`` shingles of each have one in common, so links only have to be sought among texts that
share one of these. The order is that of the hashes, with shingles that a sample shows to be common at the end; any
order finds every pair, this one keeps the groups small. Most of these shingles occur in one text alone: a pass over
their bit numbers, counted exactly and kept as a bitmap of fixed size, holds them back before anything is grouped.

Two sets differ in at least as many items as their parities differ in: each item flips one of 1,024 bits, and one of
8,192 where both sets are large. That bound rules most pairs out without their sets; the others are compared whole.

Every member of a group is first compared with the group's pivot alone. Members that are linked to each other that way
need no comparison any more, so a large group of near copies costs one comparison for each of its members.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, BitFilter, discard, texts, written
from .components import components
from .shingles import SEED, shingle_hashes
from .simhash_grid import fingerprint_links, majority

PARITY = 1024                   # bits that the items of a set flip
ROWS = 1000                     # texts whose marks are held at once
LARGE, FINE = 700, 8192         # sets of more items have so many such bits as well
SAMPLED = 16                    # one text in so many shows which shingles are common
COMMON, COMMON_MOST = 8, 100_000        # texts of the sample that make a shingle common, and how many such are kept


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return set_of(shingle_hashes(text, shingle))


def set_of(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def set_key(text: str | None, shingle: int) -> int:
    """Stands for the set, as a signed number: texts with the same set are the same here."""
    return key_of(shingle_set(text, shingle))


def key_of(items: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes(), SEED)).view(np.int64))


def parity(items: np.ndarray, size: int = PARITY) -> np.ndarray:
    """``size`` bits as longs, each flipped by the items that fall to it."""
    at = (items.view(np.uint64) >> np.uint64(40)) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size) & 1 == 1).view(np.int64)


def among(items: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which items are in the sorted array, without sorting that again for each text."""
    if not len(known):
        return np.zeros(len(items), dtype=bool)
    return known[np.minimum(np.searchsorted(known, items), len(known) - 1)] == items


def prefix_size(n: int, least: float) -> int:
    return n - ceil(least * n - 1e-9) + 1 if n else 0


def common_shingles(given: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many sampled texts, sorted; at most ``COMMON_MOST``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle))], ["h"])

    sample = given.where(F.pmod("th", F.lit(SAMPLED)) == 0).select("text")
    counted = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    top = counted.orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], dtype=np.int64))


def marks(given: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, rh, fp, sh, n, prefix, bits, fine): the key of each text's set, the text's fingerprint, the set's size,
    first shingles and parities."""
    shared = given.sparkSession.sparkContext.broadcast(common_shingles(given, shingle))

    def run(batches: Batches) -> Batches:
        common = shared.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            keys, prints, sizes, prefixes, flips, fine = [], [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), shingle)
                items = set_of(hashes)
                prints.append(majority(hashes))
                late = among(items, common)
                keys.append(key_of(items))
                sizes.append(len(items))
                prefixes.append(np.concatenate([items[~late], items[late]])[:prefix_size(len(items), least)])
                flips.append(parity(items))
                fine.append(parity(items, FINE) if len(items) > LARGE else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(flips, pa.list_(pa.int64())),
                 pa.array(fine, pa.list_(pa.int64()))],
                ["doc_id", "rh", "fp", "sh", "n", "prefix", "bits", "fine"])

    return given.select("doc_id", "rh", "text").mapInArrow(
        run, "doc_id long, rh long, fp long, sh long, n int, prefix array<long>, bits array<long>, fine array<long>")


def one_each(sets: DataFrame) -> DataFrame:
    """One row for each ``fp``; only rows of a key that occurs again are shuffled."""
    again = BitFilter(sets.sparkSession, sets.groupBy("fp").count().where("count > 1").select(F.col("fp").alias("h")), 24)

    def run(batches: Batches, wanted: bool) -> Batches:
        for batch in batches:
            met = again(batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(met if wanted else ~met))

    apart = sets.mapInArrow(lambda batches: run(batches, False), sets.schema)
    return apart.unionByName(sets.mapInArrow(lambda batches: run(batches, True), sets.schema).dropDuplicates(["fp"]))


def grid_pairs(alone: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): keys of sets that the grid of fingerprints brings together.

    Each set is paired with the least key that has its fingerprint, and these keys where fingerprints differ in 1 to
    ``distance`` bits.
    """
    least = written(alone.groupBy("sh").agg(F.min("fp").alias("fp"), F.count("*").alias("sets")), "fingerprints")
    found = fingerprint_links(least.select(F.col("sh").alias("fp")), distance)
    for side in "ab":
        found = found.join(least.select(F.col("sh").alias(side), F.col("fp").alias(f"fp{side}")), side)
    same = alone.select("sh", F.col("fp").alias("b")).join(
        least.where("sets > 1").select("sh", F.col("fp").alias("a")), "sh").where("a < b").select("a", "b")
    return found.select(F.least("fpa", "fpb").alias("a"), F.greatest("fpa", "fpb").alias("b")).unionAll(same)


def not_yet_linked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of keys that are not in one group."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root{side}")), side, "left")
    return pairs.where(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select("a", "b")


def shared_only(alone: DataFrame) -> DataFrame:
    """(fp, n, at, h): the first shingles of each set but such as no other set has among its own.

    Bit numbers of hashes are counted, so a shingle that is alone may stay, one that is shared always does.
    """
    seen = alone.select(F.explode("prefix").alias("h"))
    bit = F.col("h").bitwiseAND((1 << BitFilter.LOG_BITS) - 1).cast("int")
    twice = seen.select(bit.alias("bit")).groupBy("bit").count().where("count > 1")
    keep = BitFilter(alone.sparkSession, twice.select(F.col("bit").cast("long").alias("h")))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column(2)
            h, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            met = np.flatnonzero(keep(h.to_numpy().view(np.uint64)))
            row = pa.array(row[met])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row),
                                              pa.array(at[met].astype(np.int32)), h.take(pa.array(met))],
                                             ["fp", "n", "at", "h"])

    return alone.select("fp", "n", "prefix").mapInArrow(run, "fp long, n int, at int, h long")


def may_link(pairs: DataFrame, alone: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sizes and parities allow a similarity of ``least``."""
    left, right = (alone.select(F.col("fp").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "bits", "fine")])
                   for x in "ab")
    bits, fine = (F.aggregate(F.zip_with(f"{c}a", f"{c}b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
                              F.lit(0), lambda total, x: total + x) for c in ("bits", "fine"))
    apart = F.coalesce(fine, bits)          # null where a set is not large
    both = (F.col("na") + F.col("nb") - apart) / 2          # of the items, at most
    fine = both >= F.lit(least) * (F.col("na") + F.col("nb") - both) - F.lit(1e-6)
    return pairs.join(left, "a").join(right, "b").where(fine).select("a", "b")


def verified(pairs: DataFrame, alone: DataFrame, first: DataFrame, given: DataFrame, shingle: int,
             least: float) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets have similarity ``least`` or more."""
    pairs = written(may_link(pairs, alone, least), "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = BitFilter(pairs.sparkSession, first.join(nodes, "fp").select(F.col("rh").alias("h")))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            near = wanted(batch.column(0).to_numpy().view(np.uint64))
            sets = [shingle_set(batch.column(1)[i].as_py(), shingle) for i in np.flatnonzero(near).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in sets], pa.int64()),
                                              pa.array(sets, pa.list_(pa.int64()))], ["fp", "items"])

    sets = given.select("rh", "text").mapInArrow(run, "fp long, items array<long>")
    sets = written(sets.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.first("items").alias("items")), "sets")
    left, right = (sets.select(F.col("fp").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = F.size(F.array_intersect("items_a", "items_b"))
    whole = F.size("items_a") + F.size("items_b") - both
    links = written(pairs.join(left, "a").join(right, "b").where(both >= F.lit(least) * whole - F.lit(1e-9))
                    .select("a", "b"), "links")
    discard(pairs, sets)
    return links


def may_match(a: str, b: str, least: float):
    """Whether sets of the sizes ``n`` that first meet at the places ``at`` can be similar enough."""
    col = lambda side, x: F.col(f"{side}{x}")
    rest = F.least(col(a, "n") - col(a, "at"), col(b, "n") - col(b, "at"))
    return rest >= F.lit(least / (1 + least)) * (col(a, "n") + col(b, "n")) - F.lit(1e-6)


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id): the group of near-duplicates that each document belongs to.

    Documents are linked when the Jaccard similarity of their sets of shingles is ``least`` or more; every such pair
    is in one group. ``fp`` stands for the set, ``root`` is the smallest of the group, ``component_id`` the smallest
    id. Texts without words form one group. Null ids never name a group unless it has no other id (then null).
    Repeated rows come out as often as they came in.
    """
    given = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    given = given.withColumn("rh", F.xxhash64("th", "doc_id"))
    marked = written(marks(given, shingle, least), "marks")
    # of the rows with one set, the one with the least hash over id and text is read again where the set is needed
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("rh").alias("rh")), "distinct")
    alone = written(one_each(marked.select("fp", "sh", "n", "prefix", "bits", "fine")), "alone")
    whole, marked = marked, written(marked.select("doc_id", "fp"), "keys")
    discard(whole)
    links = verified(grid_pairs(alone), alone, first, given, shingle, least)
    roots = written(components(links), "roots")
    placed = shared_only(alone)
    pivots = placed.groupBy("h").agg(F.min(F.struct("fp", "n", "at")).alias("pivot"), F.count("*").alias("members"))
    pivots = pivots.where("members > 1").select(
        "h", F.col("pivot.fp").alias("pfp"), F.col("pivot.n").alias("pn"), F.col("pivot.at").alias("pat"))
    met = written(placed.join(pivots, "h"), "met")
    near = met.where(F.col("fp") != F.col("pfp")).where(may_match("", "p", least))
    near = not_yet_linked(near.select(F.col("pfp").alias("a"), F.col("fp").alias("b")).distinct(), roots)
    links = links.unionAll(verified(near, alone, first, given, shingle, least))

    roots, bare = written(components(links), "roots"), met
    for name in ("fp", "pfp"):
        met = met.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")), name, "left")
        met = met.withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))
    rooted = written(met, "rooted")
    discard(bare)
    left, right = (rooted.select("h", *[F.col(x).alias(f"{side}{x}") for x in ("fp", "n", "at", "fp_root", "pfp_root")])
                   for side in "ab")
    # one of each pair stands outside the pivot's group; the pivot itself has been compared with all others
    rest = left.where("afp_root != apfp_root").join(right, "h").where("afp_root != bfp_root").where(
        may_match("a", "b", least))
    rest = rest.select(F.least("afp", "bfp").alias("a"), F.greatest("afp", "bfp").alias("b")).distinct()
    more = verified(rest, alone, first, given, shingle, least)
    if not more.isEmpty():
        roots = written(components(links.unionAll(more)), "roots")
    discard(rooted, alone)
    whole = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = whole.select("fp", "root").join(groups, "root").select("fp", "root", "component_id")
    return marked.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "root", "component_id")
