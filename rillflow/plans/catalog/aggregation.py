"""Aggregations."""

from ...operators.aggregates import distinct_set, grouped_sets, net_changes
from .base import F, cents, checked, number, table


@checked("SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def agg_count_by_key(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))


@checked("""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
           round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
           round(stddev_samp(l_quantity), 6) AS sd_qty, count(*) AS cnt
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
""")
def agg_basic_having(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    revenue = cents("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        number(F.sum(cents("l_quantity"))).alias("sum_qty"),
        number(F.sum(cents("l_extendedprice"))).alias("sum_price"),
        number(F.sum(revenue)).alias("revenue"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"),
        F.count("*").alias("cnt"),
    ).filter("cnt > 10")


@checked("""
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS cnt FROM lineitem GROUP BY l_returnflag
""")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("cnt"))


@checked("""
    SELECT user_id, array_to_string(list_sort(list_distinct(list(kind))), ',')
               || CASE WHEN count(*) > count(kind) THEN ',null' ELSE '' END AS kinds,
           CAST(count(DISTINCT kind) + CASE WHEN count(*) > count(kind) THEN 1 ELSE 0 END AS INTEGER) AS n
    FROM (SELECT user_id, nullif(event_type, 'signup') AS kind FROM events) GROUP BY user_id
""")
def agg_array_distinct(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.expr("nullif(event_type, 'signup')").alias("kind"))
    sets = distinct_set(rows, ["user_id"], "kind", "kinds")
    return sets.select("user_id", F.array_join("kinds", ",", "null").alias("kinds"), F.size("kinds").alias("n"))


@checked("""
    SELECT o_custkey, count(*) AS cnt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
          UNION ALL SELECT o_custkey + 1, o_totalprice FROM orders WHERE o_orderstatus = 'P')
    GROUP BY o_custkey
""")
def agg_retract(spark, sf):
    # Orders arrive, and those still pending are taken back and moved to the next customer.
    orders = table(spark, sf, "orders").select("o_custkey", cents("o_totalprice").alias("total"), "o_orderstatus")
    pending = orders.filter("o_orderstatus = 'P'")
    changes = (
        orders.withColumn("sign", F.lit(1))
        .unionByName(pending.withColumn("sign", F.lit(-1)))
        .unionByName(pending.withColumn("o_custkey", F.col("o_custkey") + 1).withColumn("sign", F.lit(1)))
    )
    out = net_changes(changes, ["o_custkey"], "sign", {"total": "total"})
    return out.select("o_custkey", "cnt", number(F.col("total")).alias("total"))


MEASURES = """count(*) AS cnt, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem"""


def _sets(spark, sf, by, **how):
    sums = {"cnt": F.lit(1).cast("bigint"), "qty": cents("l_quantity")}
    out = grouped_sets(table(spark, sf, "lineitem"), by, sums, **how)
    return out.select(*by, "cnt", number(F.col("qty")).alias("qty"))


@checked(f"SELECT l_returnflag, l_linestatus, {MEASURES} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf):
    return _sets(spark, sf, ["l_returnflag", "l_linestatus"], kind="rollup")


@checked(f"SELECT l_returnflag, l_linestatus, l_linenumber, {MEASURES} GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def agg_cube(spark, sf):
    return _sets(spark, sf, ["l_returnflag", "l_linestatus", "l_linenumber"], kind="cube")


@checked(f"""
    SELECT l_returnflag, l_linestatus, l_linenumber, {MEASURES}
    GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())
""")
def agg_grouping_sets(spark, sf):
    return _sets(spark, sf, ["l_returnflag", "l_linestatus", "l_linenumber"], kind="sets",
                 sets=[["l_returnflag", "l_linenumber"], ["l_linestatus"], []])


@checked("""
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
           CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS spent,
           max(ts) FILTER (WHERE event_type = 'view') AS last_view
    FROM events GROUP BY user_id
""")
def agg_filter(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("filter_events")
    return spark.sql("""
        SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
               CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS spent,
               max(ts) FILTER (WHERE event_type = 'view') AS last_view
        FROM filter_events GROUP BY user_id
    """)
