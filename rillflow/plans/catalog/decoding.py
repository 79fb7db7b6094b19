"""Message decoding and JSON paths."""

from ...functions.json_path import json_get
from ...operators.decode import BROKEN, decode, marked
from ...schema import Col, TableDef
from .base import F, checked, envelopes, table

# Messages of the shape {"user_id", "ip", "store", "content": {"ip", "event_time"}, "tags", "attrs", "items"}.
MESSAGE = """
    to_json(named_struct(
        'user_id', concat('uid_', user_id),
        'store', value,
        'n', event_id,
        'flag', event_id % 2 = 0,
        'content', named_struct('ip', concat('10.0.0.', user_id % 256), 'event_time', unix_millis(cast(ts as timestamp))),
        'tags', array(event_type, concat('t', user_id % 7)),
        'attrs', map('kind', event_type, 'user', cast(user_id as string)),
        'items', array(named_struct('b', user_id), named_struct('b', event_id % 10)),
        'mixed', array(array(1, 2), array(cast(user_id as int), 4))
    ))
"""


def _messages(spark, sf):
    return table(spark, sf, "events").withColumn("message", F.expr(MESSAGE))


def _decoded(spark, sf, columns, **how):
    messages = envelopes(_messages(spark, sf), F.expr(MESSAGE))
    return decode(messages, TableDef("topic1", [Col("_offset", "bigint"), *columns]), **how)


@checked("""
    SELECT event_type AS _topic, CAST(user_id AS VARCHAR) AS _key, props AS _message,
           CAST(user_id % 4 AS INTEGER) AS _partition, event_id AS _offset
    FROM events
""")
def decode_envelope(spark, sf):
    columns = [("_topic", "varchar"), ("_key", "varchar"), ("_message", "varchar"), ("_partition", "integer"),
               ("_offset", "bigint")]
    return decode(envelopes(table(spark, sf, "events"), F.col("props")), TableDef("topic1", columns))


@checked("""
    SELECT event_id AS _offset, 'uid_' || user_id AS user_id, value AS store, event_id % 2 = 0 AS flag,
           CAST(NULL AS VARCHAR) AS absent
    FROM events
""")
def decode_json_default(spark, sf):
    return _decoded(spark, sf, [Col("user_id", "varchar"), Col("store", "double"), Col("flag", "boolean"),
                                Col("absent", "varchar")])


@checked("""
    SELECT event_id AS _offset, '10.0.0.' || (user_id % 256) AS ip, epoch_us(ts) // 1000 AS event_time,
           event_type AS first_tag, 'uid_' || user_id AS uid, CAST(NULL AS VARCHAR) AS lost
    FROM events
""")
def decode_json_extend(spark, sf):
    return _decoded(spark, sf, [
        Col("ip", "varchar", "$.content.ip"), Col("event_time", "bigint", "$.content.event_time"),
        Col("first_tag", "varchar", "$.tags[0]"), Col("uid", "varchar", "$.user_id"),
        Col("lost", "varchar", "$.content.nothing"),
    ])


@checked("""
    SELECT event_id AS _offset, CAST(event_id AS INTEGER) AS n, CAST(value AS DECIMAL(12,2))::VARCHAR AS store,
           CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS whole,
           ts AS at
    FROM events
""")
def decode_typed(spark, sf):
    source = table(spark, sf, "events")
    message = F.expr("""to_json(named_struct('n', cast(event_id as string), 'store', value, 'user_id',
        concat('uid_', user_id), 'whole', '3.14', 'at', cast(cast(ts as timestamp_ntz) as string)))""")
    rows = decode(envelopes(source, message), TableDef("topic1", [
        Col("_offset", "bigint"), Col("n", "int"), Col("store", "decimal(12,2)"), Col("user_id", "bigint"),
        Col("whole", "bigint"), Col("at", "timestamp"),
    ]))
    return rows.withColumn("store", F.col("store").cast("string")).withColumn("at", F.col("at").cast("timestamp_ntz"))


@checked("""
    SELECT event_id AS _offset, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS _key,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_type <> 'error'
""")
def decode_drop_null(spark, sf):
    messages = envelopes(table(spark, sf, "events"), F.col("props"))
    holes = messages.withColumn("value", F.expr("if(topic = 'error', null, value)")).withColumn(
        "key", F.expr("if(topic = 'view', null, key)"))
    return decode(holes, TableDef("topic1", [("_offset", "bigint"), ("_key", "varchar"), ("k", "bigint")]))


@checked("""
    SELECT event_id AS _offset, CAST(2 AS INTEGER) AS n_tags, event_type || '|t' || (user_id % 7) AS tags,
           event_type AS kind, CAST(user_id AS VARCHAR) AS attr_user,
           user_id AS first_b, event_id % 10 AS second_b
    FROM events
""")
def decode_nested(spark, sf):
    rows = _decoded(spark, sf, [Col("tags", "array(varchar)"), Col("attrs", "map(varchar, varchar)"),
                                Col("items", "row(b bigint) array")])
    return rows.select(
        "_offset", F.size("tags").alias("n_tags"), F.array_join("tags", "|").alias("tags"),
        F.col("attrs")["kind"].alias("kind"), F.col("attrs")["user"].alias("attr_user"),
        F.col("items")[0]["b"].alias("first_b"), F.col("items")[1]["b"].alias("second_b"),
    )


@checked("""
    SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'bad' ELSE 'good' END AS side, event_id AS id,
           CASE WHEN event_type = 'error' THEN props[1:length(props) - 1] WHEN event_type = 'signup' THEN '[' || props || ']'
                END AS raw,
           CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
    FROM events
""")
def decode_quarantine(spark, sf):
    messages = envelopes(table(spark, sf, "events"), F.expr("""
        case when event_type = 'error' then substring(props, 1, length(props) - 1)
             when event_type = 'signup' then concat('[', props, ']') else props end"""))
    rows, broken = marked(messages, TableDef("topic1", [("_offset", "bigint"), ("k", "bigint")])), F.col(BROKEN)
    return rows.select(
        F.when(broken, "bad").otherwise("good").alias("side"), F.col("_offset").alias("id"),
        F.when(broken, F.col("value").cast("string")).alias("raw"), F.when(~broken, F.col("k")).alias("k"))


@checked("""
    SELECT event_id, '10.0.0.' || (user_id % 256) AS ip, event_id % 2 = 0 AS flag,
           '["' || event_type || '","t' || (user_id % 7) || '"]' AS tags,
           CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS no_root, CAST(NULL AS VARCHAR) AS bad_start,
           CAST(NULL AS VARCHAR) AS broken
    FROM events
""", name="json_get")
def json_get_paths(spark, sf):
    m = F.col("message")
    return _messages(spark, sf).select(
        "event_id", json_get(m, "$.content.ip").alias("ip"),
        (json_get(m, "$.flag") == "true").alias("flag"), json_get(m, "$.tags").alias("tags"),
        json_get(m, "$.content.nothing").alias("missing"), json_get(m, "content.ip").alias("no_root"),
        json_get(m, "$content").alias("bad_start"),
        json_get(F.substring(m, 1, 20), "$.user_id").alias("broken"),
    )


@checked("""
    SELECT event_id, '[' || user_id || ',' || (event_id % 10) || ']' AS b,
           '[' || user_id || ',' || (event_id % 10) || ']' AS starred,
           CAST(NULL AS VARCHAR) AS of_text,
           CASE WHEN event_type = 'click' THEN '[1,2,' || user_id || ']' ELSE '[' || user_id || ']' END AS opened
    FROM events
""")
def json_path_flatten(spark, sf):
    m = F.col("message")
    lists = F.expr("""concat('{"a":[{"c":null},7,', if(event_type = 'click', '{"c":[1,2]},', ''), '{"c":', user_id, '}]}')""")
    return _messages(spark, sf).withColumn("lists", lists).select(
        "event_id", json_get(m, "$.items.b").alias("b"), json_get(m, "$.items[*].b").alias("starred"),
        json_get(m, "$.tags.b").alias("of_text"), json_get(F.col("lists"), "$.a.c").alias("opened"),
    )


@checked("""
    SELECT event_id, 't' || (user_id % 7) AS second, CAST(NULL AS VARCHAR) AS beyond, CAST(user_id AS VARCHAR) AS inner_b,
           '[1,2,' || CAST(user_id AS INTEGER) || ',4]' AS chained, '[2,4]' AS column_two, '[1,2]' AS first_row,
           '["' || event_type || '","t' || (user_id % 7) || '"]' AS starred,
           '["' || event_type || '","t' || (user_id % 7) || '"]' AS unclosed
    FROM events
""")
def json_index(spark, sf):
    m = F.col("message")
    return _messages(spark, sf).select(
        "event_id", json_get(m, "$.tags[1]").alias("second"), json_get(m, "$.tags[9]").alias("beyond"),
        json_get(m, "$.items[0].b").alias("inner_b"), json_get(m, "$.mixed[*][*]").alias("chained"),
        json_get(m, "$.mixed[*][1]").alias("column_two"), json_get(m, "$.mixed[0]").alias("first_row"),
        json_get(m, "$.tags[*]").alias("starred"), json_get(m, "$.tags[1").alias("unclosed"),
    )


@checked("""
    SELECT event_id, event_type AS dotted, CAST(user_id AS VARCHAR) AS keyed, CAST(NULL AS VARCHAR) AS not_a_list,
           event_type AS only_one, '["' || event_type || '",{"x":' || user_id || '}]' AS whole
    FROM events
""")
def json_root_array(spark, sf):
    listed = F.expr("to_json(array(event_type))")
    rows = table(spark, sf, "events").withColumn(
        "m", F.concat(F.expr("substring(to_json(array(event_type)), 1, length(to_json(array(event_type))) - 1)"),
                      F.lit(',{"x":'), F.col("user_id").cast("string"), F.lit("}]")))
    return rows.select(
        "event_id", json_get(F.col("m"), "$.[0]").alias("dotted"), json_get(F.col("m"), "$[1].x").alias("keyed"),
        json_get(F.col("m"), "$.x").alias("not_a_list"), json_get(listed, "$[*]").alias("only_one"),
        json_get(F.col("m"), "$").alias("whole"),
    )
