"""SimHash near-duplicates by segment popcounts: a grid join under Manhattan distance, then exact verification.

A 64-bit fingerprint maps to 32 counts, the set bits of each 2-bit segment. One flipped bit changes one count by one,
so the Manhattan distance of two count vectors never exceeds the Hamming distance of the fingerprints. Vectors within
distance ``d`` that are cut into ``2 d`` blocks agree in at least ``d`` of them, which makes the grid: each choice of
``d`` blocks is one set of cells, and links only have to be sought inside cells.

Counts are kept in unary (0: 00, 1: 01, 2: 11), so that a vector is one long and a Manhattan distance the number of
differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, query, table, texts, written
from .components import components
from .shingles import shingle_hashes

BITS, SEGMENT = 64, 2
ODD = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit number; zero for a text without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def counts(fp: Column) -> Column:
    """The segment counts in unary: in each pair of bits, "either" below "both"."""
    odd, next_bit = F.lit(ODD), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(next_bit).bitwiseAND(odd).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(odd), 1))


def cell_masks(distance: int) -> list[int]:
    """The bits that each set of cells looks at: every choice of ``distance`` of ``2 * distance`` blocks of segments."""
    blocks = np.array_split(np.arange(BITS // SEGMENT), 2 * distance)
    masks = []
    for chosen in combinations(blocks, distance):
        mask = sum(3 << (SEGMENT * int(s)) for block in chosen for s in block)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def fingerprint_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) for every two fingerprints of the column ``fp`` (distinct values) that differ in 1 to ``distance`` bits.

    Candidates are pairs in a common cell; the Manhattan bound and the exact distance are tested as they are met.
    The work is that of the distinct fingerprints, so copies of a text cost nothing here.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("set"), F.col("v").bitwiseAND(F.lit(m)).alias("cell"))
                      for i, m in enumerate(cell_masks(distance))])
    placed = distinct.select("fp", counts(F.col("fp")).alias("v")).select("fp", F.explode(cells).alias("c"))
    placed = placed.select("fp", "c.set", "c.cell")         # counts are cheaper to take again than to shuffle
    left, right = (placed.select(F.col("fp").alias(n), "set", "cell") for n in "ab")
    near = (
        (F.col("a") < F.col("b"))
        & (F.bit_count(counts(F.col("a")).bitwiseXOR(counts(F.col("b")))) <= distance)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    return left.join(right, ["set", "cell"]).where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3) -> DataFrame:
    """(doc_id, fp, root, component_id): the group of near-duplicates that each document belongs to.

    ``root`` is the smallest fingerprint of the group, ``component_id`` the smallest id. Texts without words have
    fingerprint zero and are linked like others. Null ids take part but never name a group unless it has no other id
    (then null). Repeated rows come out as often as they came in.
    """
    marked = written(fingerprints(texts(docs, id_col, text_col), shingle), "fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(fingerprint_links(first.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.select("fp", "root").join(groups, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3, least: float | None = None) -> DataFrame:
    """The documents (doc_id, text, ...) without near-duplicates: of each group the one with the smallest id stays.

    Near-duplicates are texts whose fingerprints differ in at most ``distance`` bits or, where ``least`` is given,
    whose sets of shingles have a Jaccard similarity of ``least`` or more, which the same grid seeks first and a prefix
    join where texts differ in more bits; ``shingle`` is the words of a shingle.
    Rows that repeat an id count once. Among documents without an id one stays, if nothing in its group has an id.
    """
    from .similar import set_key, similar       # which seeks links by the grid of this module

    if least is None:
        found, marked = near_duplicates(docs, distance, shingle=shingle), lambda text: fingerprint(text, shingle)
    else:
        found, marked = similar(docs, shingle, least), lambda text: set_key(text, shingle)
    groups = written(found, "groups")
    keepers = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(keepers, "doc_id").dropDuplicates(["doc_id"]).select(*docs.columns)
    mark = F.udf(marked, "long")
    nameless = groups.where("component_id is null").select("fp", "root").distinct()
    lone = docs.where(docs["doc_id"].isNull()).select(F.struct(*docs.columns).alias("row"), mark("text").alias("fp"))
    lone = lone.join(nameless, "fp").dropDuplicates(["root"]).select("row.*")
    return kept.unionByName(lone)


@query("op5_simhash_grid")
def simhash_grid(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
