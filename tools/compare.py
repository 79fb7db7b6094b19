"""Compare queries with their SQL on one scale: ``python tools/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from rillflow.plans.catalog import CATALOG  # noqa: E402
from rillflow.session import build_session  # noqa: E402


def connect(folder: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return Counter(tuple(canonical(row[at]) for at in order) for row in data)


def difference(spark, db, name: str, folder: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    entry = CATALOG[name]
    ours = entry.run(spark, folder)
    got = ours.toArrow()
    data = list(zip(*[column.to_pylist() for column in got.columns])) if got.num_columns else []
    if entry.sql is None:
        return None if data else "no rows"
    relation = db.sql(entry.sql)
    if sorted(got.column_names) != sorted(relation.columns):
        return f"columns {got.column_names} and {relation.columns}"
    left, right = rows(got.column_names, data), rows(relation.columns, relation.fetchall())
    if left != right:
        return f"{sum(left.values())} and {sum(right.values())} rows; " \
               f"only ours {list((left - right).items())[:2]}; only SQL {list((right - left).items())[:2]}"
    kinds = {"int64": "BIGINT", "int32": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "bool": "BOOLEAN",
             "timestamp[us]": "TIMESTAMP", "date32[day]": "DATE"}
    types = dict(zip(relation.columns, map(str, relation.types)))
    odd = {n: (str(got.schema.field(n).type), types[n]) for n in got.column_names
           if kinds.get(str(got.schema.field(n).type)) != types[n]}
    return f"types {odd}" if odd else None


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(folder), []
    for name in args or CATALOG:
        begin = time.time()
        try:
            problem = difference(spark, db, name, folder)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed of {len(args or CATALOG)}: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
