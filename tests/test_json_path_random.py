"""JSON paths on random documents against a plain Python reading of the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from rillflow.functions import json_get

PATHS = [
    "$.a", "$.a.b", "$.a.b.c", "$.a[0]", "$.a[1].b", "$.a[*]", "$.a[*].b", "$.a.b[*]", "$.a.b[0]", "$.a[*][0]",
    "$.a[0][*]", "$.a[*].b.c", "$.a.b[*].c", "$.a[*].b[1]", "$[0]", "$[*]", "$[*].a", "$[0].a.b", "$.[1].a", "$.b.a[*].c",
    "$[*].a[*].b", "$.a[*][*]", "$.c[2]", "$",
]


def value(draw, depth=0):
    kind = draw.random()
    if depth > 3 or kind < 0.25:
        return draw.choice([1, 2, -7, True, False, None, 2.5, "x", "[1]", '{"b":1}', "", "q\"[", "null"])
    if kind < 0.6:
        return {key: value(draw, depth + 1) for key in draw.sample("abc", draw.randint(0, 3))}
    return [value(draw, depth + 1) for _ in range(draw.randint(0, 3))]


def by_key(found, key):
    if isinstance(found, dict):
        return found.get(key)
    if not isinstance(found, list):
        return None
    out = []
    for item in found:
        inner = item.get(key) if isinstance(item, dict) else None
        out += inner if isinstance(inner, list) else [] if inner is None else [inner]
    return out or None


def by_positions(found, positions):
    hits = [found]
    for position in positions:
        lists = [hit for hit in hits if isinstance(hit, list)]
        hits = sum(lists, []) if position == "*" else [x[int(position)] for x in lists if int(position) < len(x)]
        if not hits:
            return None
    return hits if len(hits) > 1 else hits[0]


def expected(document, path):
    if path == "$":
        found = document if isinstance(document, (dict, list)) else None
    else:
        rooted = path[1] == "[" or path[2] == "["
        found = document if isinstance(document, list if rooted else dict) else None
        for at, part in enumerate(path.split(".")[0 if path[1] == "[" else 1:]):
            if not (rooted and at == 0):
                found = by_key(found, re.match(r"\w+", part)[0])
            positions = re.findall(r"\[(\d+|\*)\]", part)
            if positions and found is not None:
                found = by_positions(found, positions)
    if found is None or isinstance(found, str):
        return found
    return json.dumps(found, separators=(",", ":"))


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(11)
    return [value(draw) for _ in range(1500)]


def test_random_documents(spark, documents):
    texts = [(at, json.dumps(document)) for at, document in enumerate(documents)]
    rows = spark.createDataFrame(texts, "id int, doc string").repartition(8)
    got = rows.select("id", *[json_get(F.col("doc"), path).alias(f"p{at}") for at, path in enumerate(PATHS)]).collect()
    wrong = [
        (PATHS[at], texts[row.id][1], row[f"p{at}"], expected(documents[row.id], PATHS[at]))
        for row in got for at in range(len(PATHS)) if row[f"p{at}"] != expected(documents[row.id], PATHS[at])
    ]
    assert not wrong, (len(wrong), wrong[:5])
    hits = sum(expected(document, path) is not None for document in documents for path in PATHS)
    assert hits > 2000
