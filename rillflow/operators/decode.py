"""Message decoding: envelope columns and typed JSON columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_path import json_read
from ..schema import Col, TableDef

# Reserved column names and the envelope expression of each.
RESERVED = {
    "_topic": "topic",
    "_key": "cast(key as string)",
    "_message": "cast(value as string)",
    "_partition": "partition",
    "_offset": "offset",
}

PLAIN_PATH = re.compile(r"\$(\.[A-Za-z0-9_\-]+)+")
PARSED, BROKEN = "__parsed", "__broken"


def _path(col: Col) -> str:
    return col.path or f"$.{col.name}"


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def _place(tree: dict, keys: list[str], leaf: T.DataType) -> bool:
    """Add one leaf to the parse tree; False when it clashes with another."""
    *parents, last = keys
    for key in parents:
        tree = tree.setdefault(key, {})
        if not isinstance(tree, dict):
            return False
    if last in tree or any(key.lower() == last.lower() for key in tree):
        return tree.get(last) == leaf
    tree[last] = leaf
    return True


def _clashes(tree: dict, keys: list[str]) -> bool:
    for key in keys:
        if not isinstance(tree, dict):
            return True
        if key not in tree and any(other.lower() == key.lower() for other in tree):
            return True
        tree = tree.get(key, {})
    return False


def _struct(tree: dict) -> T.StructType:
    return T.StructType([
        T.StructField(name, _struct(kind) if isinstance(kind, dict) else kind) for name, kind in tree.items()
    ])


def _typed(text: Column, kind: T.DataType, strict: bool) -> Column:
    """JSON text as ``kind``; text that does not fit is null, or an error when strict."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(text)
    if _nested(kind):
        return F.from_json(text, kind, {"mode": "FAILFAST"} if strict else {})
    return text.cast(kind) if strict else text.try_cast(kind)


def decode(envelopes: DataFrame, table: TableDef, strict: bool = False, keep: tuple[str, ...] = (),
           mark_broken: bool = False) -> DataFrame:
    """Rows of ``table`` from envelopes; messages without a value give no row.

    All columns with plain key paths come out of a single parse per message,
    with a schema of just those keys. Scalars are taken as text and cast, so
    ``"5"`` and ``5`` both fill a bigint column. ``keep`` names further input
    columns to carry along.
    """
    message = F.col("value").cast("string")
    tree: dict = {}
    from_tree: dict[str, list[str]] = {}
    for col in table.columns:
        if col.name in RESERVED:
            continue
        path, kind = _path(col), col.spark_type
        if not PLAIN_PATH.fullmatch(path):
            continue
        keys = path[2:].split(".")
        leaf = kind if _nested(kind) and not strict else T.StringType()
        if not _clashes(tree, keys) and _place(tree, keys, leaf):
            from_tree[col.name] = keys

    rows = envelopes.filter(F.col("value").isNotNull())
    if tree or mark_broken:
        parse = _struct(tree)
        options = {}
        if mark_broken:
            parse = parse.add(BROKEN, T.StringType())
            options = {"columnNameOfCorruptRecord": BROKEN}
        rows = rows.withColumn(PARSED, F.from_json(message, parse, options))

    out = []
    for col in table.columns:
        kind = col.spark_type
        if col.name in RESERVED:
            value = F.expr(RESERVED[col.name]).cast(kind)
        elif col.name in from_tree:
            leaf = F.col(PARSED)
            for key in from_tree[col.name]:
                leaf = leaf.getField(key)
            value = leaf if _nested(kind) and not strict else _typed(leaf, kind, strict)
        else:
            value = _typed(json_read(message, _path(col)), kind, strict)
        out.append(value.alias(col.name, metadata=col.struct_field().metadata))
    if mark_broken:
        # A type mismatch also fills the corrupt column, so look at the text itself.
        whole = F.get_json_object(message, "$")
        suspect = F.col(PARSED).isNull() | F.col(PARSED).getField(BROKEN).isNotNull()
        out.append((suspect & (whole.isNull() | ~whole.startswith("{"))).alias(BROKEN))
    return rows.select(*keep, *out)


def marked(envelopes: DataFrame, table: TableDef) -> DataFrame:
    """Decoded rows beside the envelope columns not declared, and ``BROKEN``: the message is not a JSON object.

    One parse for both sides; a fan-out over it writes them apart without another.
    """
    carried = tuple(name for name in envelopes.columns if name not in {col.name for col in table.columns})
    return decode(envelopes, table, keep=carried, mark_broken=True)


def quarantine(envelopes: DataFrame, table: TableDef) -> tuple[DataFrame, DataFrame]:
    """Decoded rows, and the envelopes whose message is not a JSON object."""
    rows, names = marked(envelopes, table), [col.name for col in table.columns]
    carried = [name for name in rows.columns if name not in {*names, BROKEN}]
    return rows.filter(~F.col(BROKEN)).select(*names), rows.filter(F.col(BROKEN)).select(*carried)
