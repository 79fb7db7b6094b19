"""A trie of conversation prefixes: double arrays for each shard of prefixes, upper nodes put together globally.

Every turn knows its node by the hash of its prefix. A node with more than ``SHARD_TURNS`` turns below it is an upper
node; what hangs below the upper nodes is dealt out to shards. A shard packs its prefixes into BASE and CHECK arrays over
dense turn ids and traverses them for its nodes. Upper nodes, which several shards share, take their sums from running
totals along the conversations that reach them. Only the first of equal conversations goes into a trie, with their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Batches, query, table, written

SHARD_TURNS = 10_000    # turns of a shard, on average; a node with more turns below it is an upper node
BUCKET = 4096           # turns, or ids, that are brought together at once
SHARED, GROUP = 4, 20   # conversations take less than SHARED turns from the first of their GROUP
FREE = -1


class DoubleArray:
    """A trie in two arrays: state ``s`` goes by label ``x`` to ``BASE[s] + x`` if ``CHECK`` says ``s`` there. State 0 is the root."""

    def __init__(self):
        self.base, self.check, self.free = np.zeros(64, np.int64), np.full(64, FREE, np.int64), 1
        self.check[0] = 0

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, FREE, np.int64)]

    def _fit(self, labels: np.ndarray) -> int:
        """The base nearest to the front with room for ascending labels."""
        while self.free < len(self.check) and self.check[self.free] != FREE:
            self.free += 1
        span, at, step = int(labels[-1] - labels[0]), self.free, max(16, 200_000 // len(labels))
        while True:
            self._reach(at + step + span + 1)
            room = self.check[at:at + step] == FREE
            places = at + np.flatnonzero(room)
            if len(labels) > 1 and len(places):
                ahead = self.check[places[:, None] + (labels - labels[0])[None, :]] == FREE
                places = places[ahead.all(axis=1)]
            if len(places):
                return int(places[0] - labels[0])
            at += step

    def extend(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The states reached from ``states`` by ``labels``; states that have no children yet get all of theirs at once."""
        pairs = np.unique(np.stack([states, labels], axis=1), axis=0)
        edges = np.r_[np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]), len(pairs)]
        for low, high in zip(edges[:-1], edges[1:]):
            state, own = pairs[low, 0], pairs[low:high, 1]
            base = self._fit(own)
            self.base[state] = base
            self.check[base + own] = state
        return self.go(states, labels)

    def go(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The states reached by walking, -1 where there is none."""
        at = self.base[states] + labels
        inside = (at > 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == states), at, -1)


NODE = ("conv_id long, depth long, a long, b long, pa long, pb long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long")


def shard_nodes(turns: pa.Table) -> pa.Table:
    """The nodes of a shard from its turns (conv, d, key, words, copies, a, b, pa, pb), one path for each conv.

    A shard's tries hang below upper nodes, so their topmost nodes have no parent here: parent_conv_id is null.
    """
    turns = turns.sort_by([("conv", "ascending"), ("d", "ascending")])
    column = {name: turns.column(name).to_numpy() for name in ("conv", "d", "words", "copies", "a", "b")}
    turn_ids = turns.column("key").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    begin = np.flatnonzero(np.r_[True, column["conv"][1:] != column["conv"][:-1]])
    length = np.diff(np.r_[begin, len(turn_ids)])
    tops = np.stack([column[c][begin] for c in ("d", "a", "b")], axis=1)
    top_ids = np.unique(tops, axis=0, return_inverse=True)[1].reshape(-1)

    trie, levels = DoubleArray(), []
    active, state, level = np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64), 0
    reached = np.zeros(len(turn_ids), dtype=np.int64)
    while len(active):
        rows = begin[active] + level
        state = trie.extend(state, turn_ids[rows] if level else top_ids[active])
        reached[rows] = state
        levels.append(np.unique(state))
        level += 1
        left = length[active] > level
        active, state = active[left], state[left]

    size = len(trie.check)
    convs, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
    first, row = np.full(size, np.iinfo(np.int64).max), np.zeros(size, dtype=np.int64)
    np.add.at(convs, reached, column["copies"])
    np.minimum.at(first, reached, column["conv"])
    row[reached] = np.arange(len(reached))
    nodes = np.concatenate(levels)
    parents = trie.check[nodes]
    children = np.bincount(parents, minlength=size)
    leaves[nodes] = children[nodes] == 0
    saved[nodes] = (convs[nodes] - 1) * column["words"][row[nodes]]
    for states in reversed(levels[1:]):
        np.add.at(leaves, trie.check[states], leaves[states])
        np.add.at(saved, trie.check[states], saved[states])
    at, top = row[nodes], parents == 0
    taken = turns.select(["a", "b", "pa", "pb"]).take(pa.array(at))
    found = [first[nodes], column["d"][at].astype(np.int64), *taken.columns, pa.array(first[parents], mask=top), convs[nodes],
             children[nodes], leaves[nodes], saved[nodes]]
    return pa.table(found, names=[f.split()[0] for f in NODE.split(", ")])


def running(rows: DataFrame, keys: list[str], at: str, totals: dict[str, str], back: bool = False) -> DataFrame:
    """Adds running totals along ``at``, a dense position: ``totals`` maps new columns to aggregates in SQL.

    A key's rows are never together: buckets of positions have totals of their own, carried along a row per bucket.
    ``back`` runs from the end.
    """
    along = (lambda c: F.col(c).desc()) if back else F.col
    bucketed = rows.withColumn("__bucket", F.floor(F.col(at) / BUCKET))
    local = Window.partitionBy(*keys, "__bucket").orderBy(along(at)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(along("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy(*keys, "__bucket").agg(*[F.expr(x).alias(n) for n, x in totals.items()])
    outer = {n: x.split("(")[0] for n, x in totals.items()}
    carried = sums.select(*keys, "__bucket", *[F.expr(f"{f}({n})").over(before).alias(f"__{n}") for n, f in outer.items()])
    first = next(iter(totals))
    out = bucketed.withColumns({n: F.expr(x).over(local) for n, x in totals.items()}).join(
        carried.where(F.col(f"__{first}").isNotNull()), [*keys, "__bucket"], "left")
    put = {"bit_xor": lambda x, y: x.bitwiseXOR(y), "sum": lambda x, y: x + y}
    for n, f in outer.items():
        out = out.withColumn(n, put[f](F.col(n), F.coalesce(f"__{n}", F.lit(0))))
    return out.select(*rows.columns, *totals)


def numbered(turns: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a turn in its conversation from 0, and ``n``, its conversation's turns.

    Turns are sorted by ranges, so a long conversation lies in many partitions, each of which numbers its own part.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key")]
    spread = F.monotonically_increasing_id()
    placed = written(turns.withColumn("row", spread).repartitionByRange(*order, "row").withColumn(
        "part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("conv", "part").count()
    along = Window.partitionBy("conv").orderBy("part")
    parts = parts.select(
        "conv", "part", F.coalesce(F.sum("count").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lead"),
        F.sum("count").over(Window.partitionBy("conv")).alias("n"))
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:])) - 1
    return placed.withColumn("local", local).join(parts, ["conv", "part"]).select(
        *turns.columns, (F.col("local") + F.col("lead")).alias("rank"), "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, d, key, words) of the rebuilt turns, d from 1, and (conv, length) of every conversation."""
    ranked = written(numbered(turns), "ranked")
    sizes = ranked.where("rank = 0").select("conv", "n")
    base = F.col("conv") - F.col("conv") % GROUP
    convs = sizes.select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string")) % SHARED).alias("h"))
    given = sizes.select(F.col("conv").alias("base"), F.col("n").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = written(convs.join(given, "base", "left").select(
        "conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    heads = ranked.where(F.col("rank") < SHARED - 1).where(F.col("conv") % GROUP == 0).select(
        F.col("conv").alias("base"), "rank", "key", "words")
    head = convs.where("h > 0").join(heads, "base").where("rank < h").select("conv", (F.col("rank") + 1).alias("d"), "key", "words")
    own = ranked.where(F.col("rank") >= F.crc32(F.col("conv").cast("string")) % SHARED).join(
        convs.select("conv", "h", "taken"), "conv")
    own = own.select("conv", (F.col("rank") - F.col("h") + F.col("taken") + 1).alias("d"), "key", "words")
    return head.unionByName(own), convs.select("conv", "length")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) over the ids ``conv`` of (depth, a, b), ascending; ids reach their node in blocks."""
    blocks = ends.groupBy("depth", "a", "b", F.floor(F.col("conv") / BUCKET).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    sorted_blocks = blocks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "block")

    def run(batches: Batches) -> Batches:
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key == node:
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield rows(out)
        if node:
            yield rows([(*node, digest.hexdigest())])

    def rows(out) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*[pa.int64()] * 3, pa.string()])],
                                          ["depth", "a", "b", "ends_sha256"])

    return sorted_blocks.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def upper_nodes(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (turns at upper nodes), with what the shards' topmost nodes ``tops`` say about those below."""
    node = ["depth", "a", "b"]
    own = rows.groupBy(*node).agg(
        F.min("conv").alias("conv_id"), F.sum("copies").alias("n_convs"), F.first("words").alias("words"),
        F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    own = written(own.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "upper")
    below = own.select(F.col("depth") - 1, "pa", "pb").unionAll(tops.select(F.col("depth") - 1, "pa", "pb"))
    children = below.toDF(*node).groupBy(*node).agg(F.count("*").alias("n_children"))
    # Each node's worth stands at the turn of one conversation that reaches it; from there it counts for all turns before.
    worth = own.select(F.col("conv_id").alias("conv"), "depth", F.col("own").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    worth = worth.unionByName(tops.select(F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("depth"),
                                          F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")))
    worth = worth.groupBy("conv", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = rows.select("conv", *node).join(worth, ["conv", "depth"], "left").na.fill(0, ["saved", "leaves"])
    paths = running(paths, ["conv"], "depth", {"saved_tokens": "sum(saved)", "n_leaves": "sum(leaves)"}, back=True)
    sums = paths.groupBy(*node).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    return own.join(children, node).join(sums, node).select(
        "conv_id", *node, "pa", "pb", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Conversation c consists of the first h original turns of conversation c - c % 20 (all if it has fewer, none if there
    is no such conversation) and its own turns after its first h; h is crc32 of the decimal c, modulo 4. Columns: conv_id
    (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree, members but one times the words of the node's last text) and ends_sha256 (of the ids
    of conversations that end at the node, ascending, joined by commas).

    Turns go by ``turn``, null first, then by a digest of role and text. Null roles and texts are empty; a turn without
    text is a turn. Repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out.
    For negative ids % has the sign of the id. No conversations give no rows, else there is a root; one conversation may
    hold any share of the turns. ``shard_turns`` changes no result.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    given = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv"), turns["turn"].alias("turn"),
        F.md5(F.concat_ws(":", F.octet_length(role), role, text)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    paths, convs = rebuilt(given)
    x, y = F.xxhash64("key", "d"), F.xxhash64("d", "key", F.lit(1))
    paths = paths.withColumns({"d": F.col("d").cast("long"), "x": x, "y": y})
    paths = written(running(paths, ["conv"], "d", {"a": "bit_xor(x)", "b": "bit_xor(y)"}), "paths")

    # one conversation for each distinct sequence
    ends = convs.join(paths.select("conv", F.col("d").alias("length"), "a", "b"), ["conv", "length"], "left")
    ends = written(ends.na.fill(0, ["a", "b"]).withColumnRenamed("length", "depth"), "ends")
    chosen = ends.where("depth > 0").groupBy("depth", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    rows = paths.join(chosen.select("conv", "copies", F.col("depth").alias("length")), "conv").select(
        "conv", F.col("d").alias("depth"), "key", "words", "copies", "length", "a", "b",
        F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))
    rows = written(rows, "sequences")

    node = ["depth", "a", "b"]
    below = F.sum(F.col("length") - F.col("depth") + 1)
    heavy = rows.groupBy(*node).agg(below.alias("below")).where(F.col("below") > shard_turns).select(*node, F.lit(True).alias("heavy"))
    rows = written(rows.join(heavy, node, "left").withColumn("heavy", F.col("heavy").isNotNull()), "split")
    light = rows.where("not heavy")
    top = light.groupBy("conv").agg(F.min_by(F.struct(*node), "depth").alias("top"))
    shards = F.lit(max(1, -(-rows.count() // shard_turns)))
    shard = F.pmod(F.xxhash64("top"), shards).alias("shard")
    dealt = light.join(top, "conv").select("conv", F.col("depth").alias("d"), "key", "words", "copies", "a", "b", "pa", "pb", shard)
    lower = written(dealt.groupBy("shard").applyInArrow(lambda turns: shard_nodes(turns), NODE), "lower")

    tops = lower.where("parent_conv_id is null")
    upper = written(upper_nodes(rows.where("heavy"), tops), "merged")
    joints = upper.unionByName(tops)
    all_convs = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    highest = joints.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"),
                                            F.greatest(F.coalesce(F.sum("n_leaves"), zero), F.lit(1)).alias("n_leaves"))
    root = all_convs.join(highest, F.lit(True)).select(
        "conv_id", *[zero.alias(c) for c in (*node, "pa", "pb")], F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens")
    parents = upper.unionByName(root).select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                                             F.col("conv_id").alias("parent"))
    joined = joints.join(parents, ["depth", "pa", "pb"]).withColumn("parent_conv_id", F.col("parent")).drop("parent")
    nodes = lower.where("parent_conv_id is not null").unionByName(joined).unionByName(root)
    nothing = hashlib.sha256().hexdigest()
    return nodes.join(end_hashes(ends), node, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


SQL = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(
               strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS r
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
    SELECT c.conv_id, 0 AS part, t.r, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.r < c.h
    UNION ALL SELECT c.conv_id, 1, t.r, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.r >= c.h),
paths AS (
    SELECT conv_id, text, list({'role': role, 'text': text}) OVER w AS path, row_number() OVER w AS depth
    FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT conv_id, '', [], 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
    SELECT path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs,
           len(regexp_extract_all(first(text), '[^\x20\x09-\x0D]+')) * (count(*) - 1) AS saved,
           sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.depth = p.depth), '')) AS ends
    FROM paths p JOIN last l ON l.conv_id = p.conv_id GROUP BY ALL),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, n.path[:n.depth - 1] AS above
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
children AS (SELECT above AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above),
full_nodes AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.path = l.path),
sums AS (
    SELECT path[:k] AS path, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY path[:k])
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path"""


@query("op13_prefix_double_array", SQL)
def prefix_double_array(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))
