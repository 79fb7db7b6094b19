"""User-defined functions: scalar, table and aggregate.

``register`` looks at what it is given and picks the cheapest Spark form:
SQL text becomes a SQL function that Catalyst inlines, a Python function gets
Arrow batches of pandas Series, a class with ``eval`` becomes a table function
and an ``Accumulator`` an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import data_type


class Accumulator:
    """A mergeable aggregate.

    ``state`` is the DDL of the state columns and ``result`` the result type.
    ``add`` takes a batch of values at once.
    """

    state: str
    result: str

    def zero(self) -> tuple:
        raise NotImplementedError

    def add(self, state: tuple, values: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def merge(self, left: tuple, right: tuple) -> tuple:
        raise NotImplementedError

    def finish(self, state: tuple):
        raise NotImplementedError


_accumulators: dict[str, Accumulator] = {}


def accumulator(named: str | Accumulator) -> Accumulator:
    return named if isinstance(named, Accumulator) else _accumulators[named]


def register(spark: SparkSession, name: str, what, returns: str | T.DataType | None = None,
             params: str | None = None) -> None:
    """Make ``what`` callable as ``name``.

    A string is the body of a SQL function with ``params`` (``"x int, y int"``);
    it is a table function when its body is a query and ``returns`` lists
    columns. An accumulator is used by name with :func:`aggregate_by`; it has no
    SQL call form, because Spark would gather each group whole in one task.
    """
    made = what() if isinstance(what, type) and not hasattr(what, "eval") else what
    if isinstance(made, str):
        table = made.lstrip().lower().startswith(("select", "with"))
        kind = f"TABLE({returns})" if table else data_type(returns).simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params or ''}) RETURNS {kind} RETURN {made}")
    elif isinstance(made, Accumulator):
        _accumulators[name] = made
    elif isinstance(made, type):
        spark.udtf.register(name, F.udtf(made, returnType=returns, useArrow=False))
    elif hasattr(made, "evalType") or hasattr(made, "returnType"):
        spark.udf.register(name, made)
    elif callable(made):
        if returns is None:
            raise TypeError(f"function {name}: a Python function needs its return type")
        spark.udf.register(name, F.pandas_udf(made, data_type(returns)))
    else:
        raise TypeError(f"function {name}: cannot register {type(made).__name__}")


def _state_fields(acc: Accumulator) -> list[str]:
    return [part.split()[0] for part in acc.state.split(",")]


HELD_KEYS = 50_000

# Whole numbers and truth values keep their digits beside nulls.
EXACT = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.bool_(): pd.BooleanDtype(),
}


def aggregate_by(df: DataFrame, keys: Sequence[str], acc: str | Accumulator, values: Sequence[str],
                 name: str) -> DataFrame:
    """User aggregate per key in two steps: task, key.

    Each task keeps one state per key, at most ``HELD_KEYS`` of them before it
    sends them on, so a hot key reaches its merge as one row per task or a few.
    Keys and values travel as Arrow data: null keys are a group, and large
    whole numbers keep their digits. Null values reach ``add`` as missing.
    """
    acc = accumulator(acc)
    keys, values, fields = list(keys), list(values), _state_fields(acc)
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    state_ddl, result_ddl = f"{key_ddl}, {acc.state}", f"{key_ddl}, `{name}` {acc.result}"
    state_types = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(acc.state)]
    result_type = to_arrow_type(data_type(acc.result))

    def rows(found: list[tuple], kinds: list, columns: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], columns)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))] + state_types
            frame = pa.Table.from_batches([batch.select(range(len(keys), len(keys) + len(values)))]).to_pandas(
                types_mapper=EXACT.get)
            listed = list(zip(*[c.to_pylist() for c in batch.columns[:len(keys)]]))
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(listed):
                places.setdefault(key, []).append(at)
            for key, at in places.items():
                held[key] = acc.add(held.get(key) or acc.zero(), frame.iloc[at])
            if len(held) > HELD_KEYS:
                yield rows([(*k, *s) for k, s in held.items()], kinds, [*keys, *fields])
                held.clear()
        if held:
            yield rows([(*k, *s) for k, s in held.items()], kinds, [*keys, *fields])

    def last_merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds = (), acc.zero(), []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            key = tuple(batch.column(i)[0].as_py() for i in range(len(keys)))
            for row in zip(*[batch.column(i).to_pylist() for i in range(len(keys), batch.num_columns)]):
                state = acc.merge(state, row)
        yield rows([(*key, acc.finish(state))], [*kinds, result_type], [*keys, name])

    per_task = df.select(*keys, *values).mapInArrow(states, state_ddl)
    return per_task.groupBy(*keys).applyInArrow(last_merge, result_ddl)
