"""Chat formatting as a prefix tree: initial turns that conversations share are emitted once, depth-first.

A turn's path is the sequence of its own and its predecessors' keys, so sorting nodes by path is a depth-first walk.
The walk is a range-sorted table: each partition walks its own stretch and notes which ancestors lie before it; one
row for each partition, put in order, then gives every node its global offset and the ancestors it lacks. A tree that
holds a third of all turns is therefore spread over as many tasks as any other data.
"""

from __future__ import annotations

import hashlib
import os
import re

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, query, table, written

KEY = 12                        # bytes of a turn's key in a path

# Control strings start with "<", "[" or a backslash; none of these is left in an escaped text.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
PLAIN = {v[1]: k for k, v in ESCAPES.items()}
NO_ROLE = "\\0"
TURN = re.compile(r"<\|([^<\[|]*)\|>\n([^<\[|]*)<\|end\|>\n")


def escape(text: str) -> str:
    return re.sub(r"[\\<\[|]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text)


def template(role: str | None, text: str | None) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, and what stands after it."""
    return f"<|{NO_ROLE if role is None else escape(role)}|>\n", escape(text or ""), "<|end|>\n"


def read_turns(formatted: str) -> list[tuple[str | None, str]]:
    """Roles and texts of a formatted conversation; anything but whole turns is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((None if found[1] == NO_ROLE else unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def tokenizer(path: str):
    """Encoding in which special tokens inside texts are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return model


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, level, last, path, role, text): every turn with its path. One conversation's turns form one row first."""
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                path, turns = b"", turns.as_py()
                for level, turn in enumerate(turns):
                    said = f"{'-' if turn['role'] is None else '+' + turn['role']}\n{turn['text'] or ''}".encode()
                    path += hashlib.blake2b(said, digest_size=KEY).digest()
                    out.append((conv, level == len(turns) - 1, path, turn["role"], turn["text"] or ""))
                if len(out) > 5000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          ["conv_id", "last", "path", "role", "text"])

    return whole.mapInArrow(run, "conv_id long, last boolean, path binary, role string, text string")


WALK = ("part int, at long, n long, path binary, lacking int, known array<struct<at: long, n: long>>, "
        "ids array<int>, loss_from int, loss_n int")


def walk(nodes: DataFrame, path: str, trained: str) -> DataFrame:
    """Each partition's stretch of the depth-first walk: local offsets, and how many ancestors lie before the stretch."""
    interval = pa.struct([("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        model, part, at = tokenizer(path), TaskContext.get().partitionId(), 0
        before, stack = b"", None
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            keys, roles, bodies = (batch.column(i).to_pylist() for i in range(3))
            parts = [x for role, text in zip(roles, bodies) for x in template(role, text)]
            ids = [x.ids for x in model.encode_batch(parts, add_special_tokens=False)]
            for i, (key, role) in enumerate(zip(keys, roles)):
                head, text, tail = ids[3 * i:3 * i + 3]
                if stack is None:
                    stack = [None] * (len(key) // KEY - 1)
                common = 0
                while before[common:common + KEY] == key[common:common + KEY] and common < len(before):
                    common += KEY
                if before:
                    del stack[common // KEY:]
                lacking, n = stack.count(None), len(head) + len(text) + len(tail)
                row = (part, at, n, key, lacking, [{"at": a, "n": m} for a, m in stack[lacking:]], head + text + tail,
                       len(head), len(text) if role == trained else 0)
                for column, value in zip(columns, row):
                    column.append(value)
                stack.append((at, n))
                at, before = at + n, key
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(interval),
                     pa.list_(pa.int32()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["part", "at", "n", "path", "lacking", "known", "ids", "loss_from", "loss_n"])

    return nodes.mapInArrow(run, WALK)


def prefix_tree(turns: DataFrame, tokenizer_path: str, trained: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """The packed trees and the conversations in them, from ``turns`` (conv_id, turn, role, text).

    Nodes, one per distinct turn in its context: ``at`` (offset of its tokens in the depth-first sequence of all
    trees), ``tree`` (offset of its root), ``ids``, ``position`` (position id of its first token: the tokens of its
    ancestors), ``attends`` (intervals ``at``, ``n`` of its ancestors, root first; inside a node attention is causal),
    ``loss_from`` and ``loss_n`` (the tokens of its text, none unless the role is ``trained``).
    Members, one per conversation: ``conv_id`` and ``leaf``, the offset of its last turn.

    Turns are ordered by ``turn``, then role, then text, nulls first. A null text is empty; a null role is kept apart
    from an empty one; rows with a null conversation id form one conversation. Repeated turns stay. A conversation's
    own turns pass through one task, and its paths take ``KEY`` bytes for each pair of its turns.
    """
    spark = turns.sparkSession
    turns = turns.select(turns["conv_id"].cast("long"), turns["turn"], turns["role"], turns["text"])
    placed = written(paths(turns), "turns")
    nodes = placed.groupBy("path").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = nodes.repartitionByRange("path").sortWithinPartitions("path").select("path", "role", "text")
    local = written(walk(nodes, tokenizer_path, trained), "walk")

    end = F.max_by(F.struct("n", "at", "lacking", "known"), "at").alias("end")
    base, carry, starts = 0, [], []
    for row in local.groupBy("part").agg(end).orderBy("part").collect():     # one row per partition
        starts.append((row["part"], base, list(carry)))
        last = row["end"]
        carry = carry[:last["lacking"]] + [(x["at"] + base, x["n"]) for x in [*last["known"], last]]
        base += last["at"] + last["n"]
    starts = spark.createDataFrame(starts, "part int, base long, carry array<struct<at: long, n: long>>")
    known = F.transform("known", lambda x: F.struct((x["at"] + F.col("base")).alias("at"), x["n"].alias("n")))
    trees = local.join(starts, "part").select(
        "path", (F.col("at") + F.col("base")).alias("at"), "n", "ids", "loss_from", "loss_n",
        F.concat(F.slice("carry", F.lit(1), F.col("lacking")), known).alias("attends"),
    )
    trees = trees.withColumn("tree", F.coalesce(F.try_element_at("attends", F.lit(1))["at"], F.col("at")))
    trees = trees.withColumn("position", F.aggregate("attends", F.lit(0).cast("long"), lambda n, x: n + x["n"]))
    trees = written(trees, "trees")
    leaves = placed.where("last").select("conv_id", "path").join(trees.select("path", "at"), "path")
    return trees.drop("path"), leaves.select("conv_id", F.col("at").alias("leaf"))


def conversations(trees: DataFrame, members: DataFrame) -> DataFrame:
    """Reads conversations back: (conv_id, nodes), the nodes of its path in order."""
    chain = F.concat(F.col("attends.at"), F.array("at"))
    paths = members.join(trees.select(F.col("at").alias("leaf"), chain.alias("chain")), "leaf")
    steps = paths.select("conv_id", F.posexplode("chain").alias("level", "at"))
    found = steps.join(trees.select("at", "ids", "loss_from", "loss_n"), "at")
    one = F.struct("level", "ids", "loss_from", "loss_n")
    return found.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("nodes"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(read: DataFrame, path: str) -> DataFrame:
    def run(batches: Batches) -> Batches:
        model = tokenizer(path)
        for batch in batches:
            out = []
            for conv, nodes in zip(batch.column(0).to_pylist(), batch.column(1)):
                formatted, loss = [], []
                for node in nodes.as_py():
                    ids, start = node["ids"], node["loss_from"]
                    formatted.append(model.decode(ids, skip_special_tokens=False))
                    if node["loss_n"]:
                        said = model.decode(ids[start:start + node["loss_n"]], skip_special_tokens=False)
                        loss.append(unescape(said))
                formatted, loss = "".join(formatted), "".join(loss)
                turns = read_turns(formatted)
                said = "".join(f"{role or ''}\n{text}\n" for role, text in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             [x.split()[0] for x in DIGEST.split(", ")])

    return read.mapInArrow(run, DIGEST)


SQL = r"""
WITH t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                                    (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
    SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b'), '|', '\p') AS said FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(said) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op3_prefix_tree", SQL)
def prefix_tree_chats(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path = public_tokenizers.path("byte_bpe_50k.json")
    trees, members = prefix_tree(turns, path)
    return digests(conversations(trees, members), path)
