"""Projections, filters, sorting, limits and set operations."""

from ...operators.aggregates import except_rows, intersect_rows
from ...operators.ordered import neighbours, ranked, sliding_range, sliding_rows, sliding_span, top_per_group
from .base import F, cents, checked, number, table


@checked("SELECT event_id AS id, event_type AS kind, value * 2 AS doubled FROM events")
def proj_alias(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("value") * 2).alias("doubled"))


@checked("SELECT 'global' AS scope, user_id, count(*) AS cnt FROM events GROUP BY user_id")
def proj_literal(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cnt")).select(
        F.lit("global").alias("scope"), "user_id", "cnt")


@checked("SELECT event_id, CAST(NULL AS VARCHAR) AS a1 FROM events")
def proj_typed_null(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lit(None).cast("string").alias("a1"))


@checked("SELECT event_id, event_type FROM events WHERE nullif(event_type, 'error') IS NOT NULL")
def filter_not_null(spark, sf):
    return table(spark, sf, "events").filter(F.expr("nullif(event_type, 'error')").isNotNull()).select(
        "event_id", "event_type")


@checked("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day,
           CAST(user_id AS VARCHAR) AS uid
    FROM events
""")
def cast_strict(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("ts").cast("date").alias("day"),
        F.col("user_id").cast("string").alias("uid"))


@checked("""
    SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
      AND l_discount BETWEEN 0.02 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R')
      AND NOT (l_linestatus = 'F' AND l_tax = 0) AND l_returnflag LIKE 'A%'
""")
def filter_predicates(spark, sf):
    return table(spark, sf, "lineitem").filter("""
        l_shipdate >= timestamp_ntz '1997-01-01' and l_shipdate < timestamp_ntz '1999-01-01'
        and l_discount between 0.02D and 0.07D and l_quantity < 24D and l_returnflag in ('A', 'R')
        and not (l_linestatus = 'F' and l_tax = 0D) and l_returnflag like 'A%'
    """).select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@checked("""
    SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium'
           ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code
    FROM orders
""")
def proj_case(spark, sf):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(price >= 400000, "large").when(price >= 100000, "medium").otherwise("small").alias("size"),
        F.when(status == "F", 1).when(status == "O", 2).alias("code"))


@checked("""
    SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS head, CAST(len(embedding) AS INTEGER) AS dims,
           CAST(label AS VARCHAR) AS tag, CAST(2 AS INTEGER) AS n_attrs, CAST(NULL AS VARCHAR) AS absent
    FROM embeddings
""")
def proj_nested_access(spark, sf):
    attrs = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("kind"), F.lit("vec"))
    return table(spark, sf, "embeddings").withColumn("attrs", attrs).select(
        "vec_id", F.col("embedding")[0].cast("double").alias("head"), F.size("embedding").alias("dims"),
        F.col("attrs")["label"].alias("tag"), F.size("attrs").alias("n_attrs"),
        F.try_element_at("attrs", F.lit("none")).alias("absent"))


@checked("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


@checked("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0
""")
def sample(spark, sf):
    part = F.conv(F.substring(F.md5(F.col("l_orderkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return table(spark, sf, "lineitem").filter(part % 10 == 0).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@checked("""
    SELECT l_returnflag, count(*) AS n, true AS near_share, true AS rows_of_table, true AS repeatable
    FROM lineitem GROUP BY l_returnflag
""")
def sample_random(spark, sf):
    # Which rows come is the sampler's own; how many, from where, and that a seed gives them again, can be checked.
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    drawn = [rows.sample(fraction=0.1, seed=7).groupBy(*rows.columns).count().withColumnRenamed("count", name)
             for name in ("once", "again")]
    known = rows.groupBy(*rows.columns).agg(F.count("*").alias("held"))
    met = known.join(drawn[0], rows.columns, "full").join(drawn[1], rows.columns, "full").fillna(0)
    # six standard deviations, so that a right sampler fails once in a billion tables
    expected, spread = F.sum("held") * 0.1, 6 * F.sqrt(F.sum("held") * 0.09)
    return met.groupBy("l_returnflag").agg(
        F.sum("held").alias("n"), (F.abs(F.sum("once") - expected) <= spread).alias("near_share"),
        F.every(F.col("once") <= F.col("held")).alias("rows_of_table"),
        F.every(F.col("once") == F.col("again")).alias("repeatable"))


@checked("""
    SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER exact AS BIGINT) AS row_number,
           CAST(rank() OVER tied AS BIGINT) AS rank, CAST(dense_rank() OVER tied AS BIGINT) AS dense_rank,
           round(percent_rank() OVER tied, 12) AS percent_rank, CAST(ntile(7) OVER exact AS INTEGER) AS ntile
    FROM orders
    WINDOW tied AS (PARTITION BY o_orderstatus ORDER BY o_orderdate),
           exact AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)
""")
def win_rank(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    out = ranked(rows, ["o_orderstatus"], ["o_orderdate"], month, ties=["o_orderkey"], tiles=7)
    return out.select(
        "o_orderkey", "o_orderstatus", F.col("row_number").cast("bigint").alias("row_number"),
        F.col("rank").cast("bigint").alias("rank"), F.col("dense_rank").cast("bigint").alias("dense_rank"),
        F.round("percent_rank", 12).alias("percent_rank"), "ntile")


@checked("""
    SELECT event_id, event_type, lag(value) OVER w AS lag, lead(value) OVER w AS lead,
           first_value(value) OVER w AS first_value,
           last_value(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value,
           nth_value(value, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth_value
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def win_lag_lead(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    near = neighbours(rows, ["event_type"], ["ts", "event_id"], day, "value", nth=3)
    return near.select(
        "event_id", "event_type", "lag", "lead", "first_value", "last_value", "nth_value")


@checked("""
    SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS sum_value,
           count(*) OVER w AS cnt, CAST(max(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS max_value
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def win_rows_frame(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", cents("value").alias("value"))
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    out = sliding_rows(rows, ["user_id"], ["ts", "event_id"], day, "value", 4,
                       {"sum_value": "sum", "cnt": "count", "max_value": "max"})
    return out.select("event_id", "user_id", number(F.col("sum_value")).alias("sum_value"), "cnt",
                      number(F.col("max_value")).alias("max_value"))


@checked("""
    SELECT event_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS sum_value,
           count(*) OVER w AS cnt
    FROM (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)
""")
def win_range_frame(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"),
        cents("value").alias("value"))
    out = sliding_range(rows, ["event_type"], "sec", "value", 3600, 6 * 3600, {"sum_value": "sum", "cnt": "count"})
    return out.select("event_id", "event_type", number(F.col("sum_value")).alias("sum_value"), "cnt")


@checked("""
    SELECT event_id, event_type, min(value) OVER w AS lo, max(value) OVER w AS hi,
           round(avg(CAST(round(value * 100) AS BIGINT)) OVER w, 6) AS mean_cents, count(*) OVER w AS cnt
    FROM (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND 1800 FOLLOWING)
""")
def win_range_span(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "value")
    worth = F.round(F.col("value") * 100).cast("bigint")
    out = sliding_span(rows, ["event_type"], "sec", 3600, 1800, 6 * 3600, {
        "lo": F.min("value"), "hi": F.max("value"), "mean": F.avg(worth), "cnt": F.count("*")})
    return out.select("event_id", "event_type", "lo", "hi", F.round("mean", 6).alias("mean_cents"), "cnt")


@checked("""
    SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag, 'N') AS flag, l_extendedprice
    FROM lineitem ORDER BY flag ASC NULLS LAST, l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber, l_partkey
""")
def sort_multi(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.expr("nullif(l_returnflag, 'N')").alias("flag"),
        "l_extendedprice")
    return rows.orderBy(F.col("flag").asc_nulls_last(), F.col("l_extendedprice").desc_nulls_first(), "l_orderkey",
                        "l_linenumber", "l_partkey")


@checked("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def limit_sorted(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(10).limit(50)


@checked("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@checked("""
    SELECT o_orderkey, o_custkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn <= 3
""")
def topk_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_per_group(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


def _parts(spark, sf):
    early = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey")
    late = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return early, late


PARTS = "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = "


@checked(f"{PARTS}'A' UNION ALL {PARTS}'R'")
def set_union_all(spark, sf):
    early, late = _parts(spark, sf)
    return early.unionByName(late)


@checked(f"{PARTS}'A' UNION {PARTS}'R'")
def set_union(spark, sf):
    early, late = _parts(spark, sf)
    return early.unionByName(late).distinct()


@checked(f"{PARTS}'A' INTERSECT {PARTS}'R'")
def set_intersect(spark, sf):
    early, late = _parts(spark, sf)
    return intersect_rows(early, late)


@checked(f"{PARTS}'A' INTERSECT ALL {PARTS}'R'")
def set_intersect_all(spark, sf):
    early, late = _parts(spark, sf)
    return early.intersectAll(late)


@checked(f"{PARTS}'A' EXCEPT {PARTS}'R'")
def set_except(spark, sf):
    early, late = _parts(spark, sf)
    return except_rows(early, late)


@checked(f"{PARTS}'A' EXCEPT ALL {PARTS}'R'")
def set_except_all(spark, sf):
    early, late = _parts(spark, sf)
    return early.exceptAll(late)
