import pytest
from pyspark.sql import functions as F
from rillflow.functions import json_get

DOC = '{"user_id":"uid_001","ip":"127.0.0.1","store":12.0,"key1":{"key2":123}}'
LISTS = ('{"a":[{"b":1},{"b":[2,3,null]},5,{"b":null},{"b":"x"},{"c":1}],"n":null,"l":[10,20],"m":[[1,2],[3],4],'
         '"o":{"z":1,"y":12.5},"deep":[{"a":[{"b":1},{"b":2}]},{"a":{"b":3}}],"one":[{"k":{"z":2,"a":1}}],'
         '"quo":["a\\"b","[x]","{y}",null],"a b:c-d":7}')

NESTED = ('{"rows":[[{"b":7}]],"two":[{"b":[[1],[2]]}],"pair":[{"b":[1]},{"b":[2]}],"empty":[{"b":[]}],"empties":[{"b":[]},{"b":[]}],'
          '"text":[{"b":"[x]"},{"b":1}],"lone":[{"b":"s"}],"half":[{"b":1},{"c":2}],"words":["w"],"nothing":[],'
          '"nul":[null],"str":"[{\\"b\\":1}]"}')

CASES = [
    (DOC, "$.key1.key2", "123"),
    (DOC, "$.key2.key2", None),
    (DOC, "$.store", "12.0"),
    (DOC, "$.key1", '{"key2":123}'),
    (DOC, "user_id", None),
    (DOC, "", None),
    (DOC, "$user_id", None),
    (DOC, "$..ip", None),
    (None, "$.a", None),
    ("", "$.a", None),
    ('{"a":', "$.a", None),
    ('"text"', "$", None),
    ("[1, 2]", "$", "[1,2]"),
    ('{"a" : 1}', "$", '{"a":1}'),
    (LISTS, "$.n", None),
    (LISTS, "$.a.b", '[1,2,3,null,"x"]'),
    (LISTS, "$.a[*].b", '[1,2,3,null,"x"]'),
    (LISTS, "$.a.nothing", None),
    (LISTS, "$.a[0].b", "1"),
    (LISTS, "$.a[4].b", "x"),
    (LISTS, "$.a[2].b", None),
    (LISTS, "$.l[1]", "20"),
    (LISTS, "$.l[9]", None),
    (LISTS, "$.l[1", "[10,20]"),
    (LISTS, "$.l[*]", "[10,20]"),
    (LISTS, "$.m[*][0]", "[1,3]"),
    (LISTS, "$.m[1][*]", "3"),
    (LISTS, "$.m[*][*]", "[1,2,3]"),
    (LISTS, "$.m[0]", "[1,2]"),
    (LISTS, "$.o[0]", None),
    (LISTS, "$.deep.a.b", "[1,2,3]"),
    (LISTS, "$.deep[*].a[0].b", "1"),
    (NESTED, "$.nul[0]", None),
    ('{"a":["null",null]}', "$.a[0]", "null"),
    ('{"a":["null",null]}', "$.a[1]", None),
    ('[[{"a":1}]]', "$[*].a", "[1]"),
    (NESTED, "$.rows[0].b", "[7]"),
    (NESTED, "$.rows[0][*].b", "7"),
    (NESTED, "$.rows[0][*]", '{"b":7}'),
    (NESTED, "$.two.b", '[[1],[2]]'),
    (NESTED, "$.pair.b", "[1,2]"),
    (NESTED, "$.empty.b", None),
    (NESTED, "$.empty[*].b", "[]"),
    (NESTED, "$.empties.b", None),
    (NESTED, "$.text.b", '["[x]",1]'),
    (NESTED, "$.lone.b", '["s"]'),
    (NESTED, "$.lone[*].b", "s"),
    (NESTED, "$.half[*].b", "[1]"),
    (NESTED, "$.half.b", "[1]"),
    (NESTED, "$.half[*]", '[{"b":1},{"c":2}]'),
    (NESTED, "$.lone[*]", '{"b":"s"}'),
    (NESTED, "$.words[*]", "w"),
    (NESTED, "$.nothing[*]", None),
    (NESTED, "$.nul[*]", None),
    (NESTED, "$.str.b", None),
    (LISTS, "$.one.k", '[{"z":2,"a":1}]'),
    (LISTS, "$.one[*].k", '{"z":2,"a":1}'),
    (LISTS, "$.quo[0]", 'a"b'),
    (LISTS, "$.quo[*]", '["a\\"b","[x]","{y}",null]'),
    (LISTS, "$.quo[1].x", None),
    (LISTS, "$.a b:c-d", "7"),
    ('[1,{"x":2}]', "$[1].x", "2"),
    ('[1,{"x":2}]', "$.[1].x", "2"),
    ('[1,{"x":2}]', "$.[0]", "1"),
    ('[1,{"x":2}]', "$.x", None),
    ('[[1,2],[3]]', "$[*][0]", "[1,3]"),
    ('{"x":2}', "$[0]", None),
]


@pytest.mark.parametrize("path", sorted({path for _, path, _ in CASES}))
def test_paths(spark, path):
    cases = [(doc, want) for doc, at, want in CASES if at == path]
    rows = spark.createDataFrame(cases, "doc string, want string").select(
        json_get(F.col("doc"), path).alias("got"), "want").collect()
    assert [row.got for row in rows] == [row.want for row in rows]
