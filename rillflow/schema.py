"""Declared tables: type names, columns with JSON paths, and the sink contract."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type names and the Spark type each one stands for.
TYPE_NAMES = {
    "varchar": T.StringType(),
    "string": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "tinyint": T.ByteType(),
    "byte": T.ByteType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "double": T.DoubleType(),
    "double precision": T.DoubleType(),
    "float": T.FloatType(),
    "decimal": T.DecimalType(38, 18),
    "time": T.StringType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "binary": T.BinaryType(),
    "object": T.VariantType(),
}


class SchemaError(ValueError):
    """A declaration that names an unknown type or repeats a column."""


class ContractError(ValueError):
    """A query whose result does not fit the sink it is written to."""


def _arguments(text: str) -> list[str]:
    """Comma-separated parts of ``text`` outside any bracket."""
    parts, depth, start = [], 0, 0
    for at, char in enumerate(text):
        if char in "(<":
            depth += 1
        elif char in ")>":
            depth -= 1
        elif char == "," and depth == 0:
            parts.append(text[start:at])
            start = at + 1
    parts.append(text[start:])
    return [part.strip() for part in parts]


def data_type(text: str | T.DataType) -> T.DataType:
    """Spark type of a declared type such as ``map(varchar, bigint array)``."""
    if isinstance(text, T.DataType):
        return text
    text = text.strip()
    suffix = re.fullmatch(r"(.+\S)\s+array", text, re.I | re.S)
    if suffix:
        return T.ArrayType(data_type(suffix[1]))
    shape = re.fullmatch(r"([A-Za-z]+(?:\s+[A-Za-z]+)*)\s*(?:[(<](.*)[)>])?", text, re.S)
    if not shape:
        raise SchemaError(f"cannot read type {text!r}")
    head = " ".join(shape[1].lower().split())
    args = _arguments(shape[2]) if shape[2] else []
    if head == "array" and len(args) == 1:
        return T.ArrayType(data_type(args[0]))
    if head == "map" and len(args) == 2:
        return T.MapType(data_type(args[0]), data_type(args[1]))
    if head in ("row", "struct") and args:
        named = [re.split(r"[\s:]+", arg, maxsplit=1) for arg in args]
        return T.StructType([T.StructField(name.strip('"`'), data_type(kind)) for name, kind in named])
    if head == "decimal" and args:
        return T.DecimalType(int(args[0]), int(args[1]) if len(args) > 1 else 0)
    if head in ("varchar", "char") and len(args) == 1:
        return T.StringType()
    if head in TYPE_NAMES and not args:
        return TYPE_NAMES[head]
    raise SchemaError(f"unknown type {text!r}")


@dataclass(frozen=True)
class Col:
    """One declared column; ``path`` is the JSON path it is read from."""

    name: str
    type: str | T.DataType
    path: str | None = None
    comment: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return data_type(self.type)

    def struct_field(self) -> T.StructField:
        meta = {key: val for key, val in (("path", self.path), ("comment", self.comment)) if val}
        return T.StructField(self.name, self.spark_type, True, meta)


@dataclass(frozen=True)
class Watermark:
    """Event time ``column`` read from ``source``, late by at most ``delay``."""

    source: str
    delay: str
    column: str = "rowtime"


@dataclass
class TableDef:
    """A declared table. ``name`` may be qualified; its last part is used."""

    name: str
    columns: list[Col]
    watermark: Watermark | None = None
    proctime: str | None = None
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        self.name = self.name.split(".")[-1].strip('"`')
        self.columns = [col if isinstance(col, Col) else Col(*col) for col in self.columns]
        names = [col.name for col in self.columns]
        repeated = {name for name in names if names.count(name) > 1}
        if repeated:
            raise SchemaError(f"table {self.name}: repeated columns {sorted(repeated)}")

    def struct(self) -> T.StructType:
        return T.StructType([col.struct_field() for col in self.columns])


def _plain(kind: T.DataType) -> str:
    """Type text without nullability, so that only the types are compared."""
    return kind.simpleString()


def contract_problem(query: T.StructType, sink: T.StructType) -> str | None:
    """Why ``query`` does not fit ``sink`` by position, or None when it does."""
    fits = len(query) == len(sink) and all(
        isinstance(have.dataType, T.NullType) or _plain(have.dataType) == _plain(want.dataType)
        for have, want in zip(query, sink)
    )
    if fits:
        return None

    def show(schema: T.StructType) -> str:
        return ", ".join(f"{f.name} {_plain(f.dataType)}" for f in schema)

    return f"query result [{show(query)}] does not match sink columns [{show(sink)}]"


def fit_to_sink(df: DataFrame, sink: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Check ``df`` against the sink by position and give it the sink's names.

    ``columns`` is an insert column list: sink columns it leaves out become
    null. Untyped nulls take the sink's type.
    """
    if columns is not None:
        unknown = [name for name in columns if name not in sink.names]
        if unknown or len(columns) != len(df.columns):
            raise ContractError(f"insert columns {columns} do not match query {df.columns} and sink {sink.names}")
        target = T.StructType([sink[name] for name in columns])
    else:
        target = sink
    problem = contract_problem(df.schema, target)
    if problem:
        raise ContractError(problem)
    df = df.toDF(*target.names)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in target.names else F.lit(None)).cast(f.dataType).alias(f.name)
        if f.name not in target.names or isinstance(df.schema[f.name].dataType, T.NullType)
        else F.col(f"`{f.name}`")
        for f in sink
    ])
