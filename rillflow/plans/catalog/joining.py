"""Joins."""

from ...operators.inequality import inequality_join, range_join
from ...operators.joins import asof_join, interval_join, spread_join
from .base import F, cents, checked, number, table


@checked("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def join_inner(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@checked("""
    SELECT p_brand, count(*) AS cnt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
""")
def join_inner_spread(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber",
                                               "l_extendedprice")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = spread_join(lines, parts, ["p_partkey"], ways=8, share=0.005)
    return joined.groupBy("p_brand").agg(
        F.count("*").alias("cnt"), number(F.sum(cents("l_extendedprice"))).alias("revenue"))


def _order_totals(spark, sf):
    """One row per customer, so that a busy customer joins as one row."""
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), number(F.sum(cents("o_totalprice"))).alias("total"))


TOTALS = """(SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
            FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)"""


@checked(f"""
    SELECT c_custkey, c_name, n_orders, total FROM customer LEFT JOIN {TOTALS} ON c_custkey = o_custkey
""")
def join_left(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return customers.join(_order_totals(spark, sf), F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@checked(f"""
    SELECT c_name, o_custkey, n_orders, total
    FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN {TOTALS} ON c_custkey = o_custkey
""")
def join_right(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
    return rich.join(_order_totals(spark, sf), F.col("c_custkey") == F.col("o_custkey"), "right").drop("c_custkey")


@checked(f"""
    SELECT c_custkey, o_custkey, c_name, n_orders
    FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') FULL JOIN {TOTALS} ON c_custkey = o_custkey
""")
def join_full(spark, sf):
    builders = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return builders.join(_order_totals(spark, sf), F.col("c_custkey") == F.col("o_custkey"), "full").drop("total")


@checked("""
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
""")
def join_semi(spark, sf):
    large = table(spark, sf, "orders").filter("o_totalprice > 450000").select("o_custkey").distinct()
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(
        large, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@checked("""
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
""")
def join_anti(spark, sf):
    large = table(spark, sf, "orders").filter("o_totalprice > 450000").select("o_custkey").distinct()
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(
        large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@checked("""
    SELECT s_suppkey, s_name, n_name, r_name FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def join_broadcast(spark, sf):
    # No hint: Spark broadcasts these sides because their size is below its threshold, and only then.
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", "n_name", "r_name")


@checked("""
    SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem
    ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY AND l_extendedprice * 2 > o_totalprice
""")
def join_theta(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate",
                                               "l_extendedprice")
    cond = (
        (F.col("o_orderkey") == F.col("l_orderkey"))
        & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days"))
        & (F.col("l_extendedprice") * 2 > F.col("o_totalprice"))
    )
    return orders.join(lines, cond).select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@checked("""
    WITH bands AS (SELECT s_suppkey, s_acctbal * 40 AS low, s_acctbal * 40 + 2500 AS high FROM supplier)
    SELECT o_orderkey, s_suppkey FROM orders JOIN bands ON o_totalprice >= low AND o_totalprice < high
""")
def join_range(spark, sf):
    bands = table(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_acctbal") * 40).alias("low"), (F.col("s_acctbal") * 40 + 2500).alias("high"))
    points = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return range_join(points, bands, "o_totalprice", "low", "high").select("o_orderkey", "s_suppkey")


@checked("""
    SELECT a.event_id, count(*) AS cheaper_later FROM events a JOIN events b
    ON a.event_type = 'error' AND b.event_type = 'purchase' AND a.ts < b.ts AND a.value > b.value GROUP BY a.event_id
""")
def join_inequality(spark, sf):
    # For each error the purchases after it that cost less: no equality to partition by, and pairs grow with the square.
    events = table(spark, sf, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "ts", "value")
    buys = events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"), F.col("value").alias("buy_value"))
    found = inequality_join(errors, buys, [("ts", "<", "buy_ts"), ("value", ">", "buy_value")], counted="pairs")
    return found.groupBy("event_id").agg(F.sum("pairs").alias("cheaper_later"))


@checked("""
    SELECT c.user_id, c.event_id AS click_id, p.event_id AS buy_id
    FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase'
      AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR
""")
def join_interval(spark, sf):
    events = table(spark, sf, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"),
                                                          F.col("ts").alias("click_ts"))
    buys = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"),
                                                           F.col("ts").alias("buy_ts"))
    return interval_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", 6 * 3_600_000).select(
        "user_id", "click_id", "buy_id")


@checked("""
    SELECT b.event_id, b.user_id, b.ts, v.event_id AS view_id, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') b
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts
""")
def join_asof(spark, sf):
    events = table(spark, sf, "events")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(buys, views, ["user_id"], "ts", "seen", {"view_id": "view_id", "view_value": "view_value"},
                     86_400_000, ties=["view_id"])


@checked("""
    SELECT doc_id, word, count(*) AS cnt
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE word <> '' GROUP BY doc_id, word
""")
def join_lateral_explode(spark, sf):
    table(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("lateral_docs")
    return spark.sql("""
        SELECT doc_id, word, count(*) AS cnt FROM lateral_docs LATERAL VIEW explode(split(text, ' ')) w AS word
        WHERE word <> '' GROUP BY doc_id, word
    """)
