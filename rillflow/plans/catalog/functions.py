"""Scalar functions and user-defined functions."""

import pandas as pd

from ...functions import Accumulator, aggregate_by, epoch_ms, register, to_epoch_ms
from .base import F, checked, table, zoneless


@checked("SELECT event_id, event_type || '-;->' || user_id AS joined FROM events")
def fn_concat(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.col("event_type"), F.lit("-;->"), F.col("user_id").cast("string")).alias("joined"))


@checked("""
    SELECT p_partkey, substring(p_name, 2, 4) AS part, trim('  ' || p_name || ' ') AS trimmed, upper(p_type) AS up,
           replace(p_brand, 'Brand', 'B') AS replaced, string_split(p_name, ' ')[1] AS first_word,
           regexp_extract(p_brand, '([0-9]+)', 1) AS digits, CAST(position('i' IN p_name) AS INTEGER) AS at,
           p_name LIKE '%ring' AS is_ring, CAST(length(p_name) AS INTEGER) AS n
    FROM part
""")
def fn_string(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", F.substring(name, 2, 4).alias("part"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.upper("p_type").alias("up"), F.replace(F.col("p_brand"), F.lit("Brand"), F.lit("B")).alias("replaced"),
        F.split_part(name, F.lit(" "), F.lit(1)).alias("first_word"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.instr(name, "i").alias("at"),
        name.like("%ring").alias("is_ring"), F.length(name).alias("n"))


@checked("SELECT event_id, true AS is_later FROM events")
def fn_localtimestamp(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.localtimestamp() > F.col("ts")).alias("is_later"))


@checked("SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('millisecond', ts) AS back FROM events")
def fn_epoch_ms(spark, sf):
    rows = table(spark, sf, "events").select("event_id", to_epoch_ms(F.col("ts")).alias("ms"))
    return rows.select("event_id", "ms", epoch_ms(F.col("ms")).alias("back")).withColumn("back", zoneless("back"))


@checked("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
           CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
           CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
           o_orderdate + INTERVAL 10 DAY + INTERVAL 3 HOUR AS later,
           CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
           CAST(last_day(o_orderdate) AS DATE) AS month_end, strftime(o_orderdate, '%Y/%m/%d') AS shown
    FROM orders
""")
def fn_date(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.quarter(day).alias("q"), F.month(day).alias("m"),
        F.dayofyear(day).alias("doy"), F.date_trunc("month", day).cast("timestamp_ntz").alias("month_start"),
        (day + F.expr("interval 10 days 3 hours")).alias("later"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"), F.last_day(day).alias("month_end"),
        F.date_format(day, "yyyy/MM/dd").alias("shown"))


@checked("""
    SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) AS off, round(sqrt(l_extendedprice), 6) AS root,
           CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax_pct, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS blocks,
           round(ln(l_extendedprice), 9) AS log, l_orderkey % 7 AS rest, round(power(l_quantity, 2), 2) AS squared,
           greatest(l_quantity, 10) AS at_least, CAST(sign(l_quantity - 25) AS DOUBLE) AS side
    FROM lineitem
""")
def fn_math(spark, sf):
    qty, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(qty - 25).alias("off"), F.round(F.sqrt(price), 6).alias("root"),
        F.floor(F.col("l_tax") * 100 + 0.5).alias("tax_pct"), F.ceil(price / 1000).alias("blocks"),
        F.round(F.log(price), 9).alias("log"), (F.col("l_orderkey") % 7).alias("rest"),
        F.round(F.pow(qty, F.lit(2)), 2).alias("squared"), F.greatest(qty, F.lit(10.0)).alias("at_least"),
        F.signum(qty - 25).alias("side"))


@checked("""
    SELECT conv_id, turn, CAST(len(words) AS INTEGER) AS n, list_contains(words, 'de') AS has_de,
           array_to_string(list_sort(list_distinct(words)), ' ') AS vocabulary, words[1] AS first,
           CAST(list_position(words, 'la') AS INTEGER) AS la_at
    FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS words FROM conversations)
""")
def fn_array(spark, sf):
    words = F.split(F.lower("text"), " ")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))
    la = F.array_position("words", "la")
    return rows.select(
        "conv_id", "turn", F.size("words").alias("n"), F.array_contains("words", "de").alias("has_de"),
        F.array_join(F.array_sort(F.array_distinct("words")), " ").alias("vocabulary"),
        F.col("words")[0].alias("first"), F.nullif(la, F.lit(0)).cast("int").alias("la_at"))


@checked("""
    SELECT doc_id, CAST(2 AS INTEGER) AS n, 'lang,source' AS keys, lang || ',' || source AS vals, lang AS got, true AS has_lang
    FROM documents
""")
def fn_map(spark, sf):
    about = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    rows = table(spark, sf, "documents").select("doc_id", about.alias("about"))
    return rows.select(
        "doc_id", F.size("about").alias("n"), F.array_join(F.map_keys("about"), ",").alias("keys"),
        F.array_join(F.map_values("about"), ",").alias("vals"), F.col("about")["lang"].alias("got"),
        F.map_contains_key("about", "lang").alias("has_lang"))


@checked("""
    SELECT event_id, round(value * 1.1, 4) AS taxed,
           CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END || ':' || event_type AS tag
    FROM events
""")
def udf_scalar(spark, sf):
    register(spark, "with_tax", "round(v * 1.1D, 4)", "double", "v double")

    def tag(user: pd.Series, kind: pd.Series) -> pd.Series:
        return user.mod(2).map({0: "even", 1: "odd"}) + ":" + kind

    register(spark, "tag_of", tag, "varchar")
    table(spark, sf, "events").createOrReplaceTempView("udf_events")
    return spark.sql("SELECT event_id, with_tax(value) AS taxed, tag_of(user_id, event_type) AS tag FROM udf_events")


class Spread(Accumulator):
    """Difference between the largest and the smallest value, in cents."""

    state = "lo bigint, hi bigint, n bigint"
    result = "bigint"

    def zero(self):
        return (2**62, -(2**62), 0)

    def add(self, state, values):
        cents = values.iloc[:, 0].dropna().mul(100).round().astype("int64")
        if cents.empty:
            return state
        return min(state[0], int(cents.min())), max(state[1], int(cents.max())), state[2] + len(cents)

    def merge(self, left, right):
        return min(left[0], right[0]), max(left[1], right[1]), left[2] + right[2]

    def finish(self, state):
        return state[1] - state[0] if state[2] else None


@checked("""
    SELECT event_type, CAST(round(max(value) * 100) - round(min(value) * 100) AS BIGINT) AS value_spread
    FROM events GROUP BY event_type
""")
def udaf_custom(spark, sf):
    register(spark, "spread", Spread)
    return aggregate_by(table(spark, sf, "events"), ["event_type"], "spread", ["value"], "value_spread")


@checked("""
    SELECT CASE WHEN user_id % 5 > 0 THEN 9007199254740992 + user_id % 5 END AS big, event_type = 'view' AS seen,
           CAST(round(max(v) * 100) - round(min(v) * 100) AS BIGINT) AS value_spread
    FROM (SELECT *, CASE WHEN event_id % 3 > 0 AND event_type <> 'error' THEN value END AS v FROM events) GROUP BY ALL
""")
def udaf_nullable_keys(spark, sf):
    rows = table(spark, sf, "events").select(
        F.expr("CASE WHEN user_id % 5 > 0 THEN 9007199254740992 + user_id % 5 END").alias("big"),
        (F.col("event_type") == "view").alias("seen"),
        F.expr("CASE WHEN event_id % 3 > 0 AND event_type <> 'error' THEN value END").alias("v"))
    return aggregate_by(rows, ["big", "seen"], Spread(), ["v"], "value_spread")


class Pieces:
    """Words of a text, numbered."""

    def eval(self, text: str):
        for at, piece in enumerate(text.split(" ")):
            yield at, piece


@checked("""
    SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INTEGER) AS at,
           unnest(string_split(p_name, ' ')) AS piece
    FROM part
""")
def udtf_custom(spark, sf):
    register(spark, "pieces", Pieces, "at int, piece string")
    # A call for each row costs more than its bytes tell, so rows are spread over all cores, not by the size of the file.
    parts = table(spark, sf, "part").select("p_partkey", "p_name").repartition(4 * spark.sparkContext.defaultParallelism)
    parts.createOrReplaceTempView("udtf_part")
    return spark.sql("SELECT p_partkey, at, piece FROM udtf_part, LATERAL pieces(p_name)")


@checked("""
    SELECT o_orderkey, p.kind, CAST(p.amount AS DOUBLE) AS amount
    FROM orders, LATERAL (SELECT 'net' AS kind, round(o_totalprice * 0.8, 3) AS amount
                          UNION ALL SELECT 'tax', round(o_totalprice * 0.2, 3)) p
""")
def udtf_sql(spark, sf):
    register(
        spark, "shares",
        """SELECT s.kind, s.amount FROM (SELECT explode(array(
               named_struct('kind', 'net', 'amount', round(price * 0.8D, 3)),
               named_struct('kind', 'tax', 'amount', round(price * 0.2D, 3)))) AS s)""",
        "kind string, amount double", "price double",
    )
    table(spark, sf, "orders").createOrReplaceTempView("udtf_orders")
    return spark.sql("SELECT o_orderkey, s.kind, s.amount FROM udtf_orders, LATERAL shares(o_totalprice) s")
