"""Streaming queries: windows, lateness, state, restarts and joins of streams."""

from ...operators.aggregates import net_changes
from ...operators.joins import interval_join
from ...operators.sessions import hop_totals, session_totals
from ...schema import TableDef, Watermark
from ...session import scratch
from ...sources import replay
from ...streaming import (
    ChangelogSink, KeyedProcess, LateSplit, ParquetSink, Sink, Variable, asof_stream, dedup, distinct_counts,
    distinct_sketches, drain, event_time, join_changes, keyed_process, proctime, running_state, set_changes, topk_changes, united,
)
from ...streaming.eventtime import bounds, hop, label, session, tumble, with_lateness
from ...streaming.sinks import CompleteSink
from ..pipeline import Pipeline
from .base import F, cents, checked, number, table, zoneless
from .composition import WINDOWED
from .functions import Spread


def _run(spark, rows, sink, mode=None):
    drain(rows, sink, scratch(spark, "state"), mode)
    return sink.read(spark)


def _events(spark, sf, delay="10 minutes", stream=True):
    rows = replay(spark, sf, "events") if stream else table(spark, sf, "events")
    return event_time(rows, "ts", delay)


BUCKETED = """
    SELECT {keys}, w AS window_start, w + INTERVAL {size} AS window_end, count(*) AS cnt
    FROM (SELECT *, time_bucket(INTERVAL {size}, ts) AS w FROM events) GROUP BY {keys}, w
"""


@checked(BUCKETED.format(keys="event_type", size="1 HOUR") + """
    HAVING w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
""")
def stream_watermark(spark, sf):
    # Append mode gives a window once the watermark has passed its end.
    counts = _events(spark, sf).groupBy("event_type", tumble("rowtime", "1 hour")).agg(F.count("*").alias("cnt"))
    return _run(spark, counts.select("event_type", *bounds(), "cnt"), ParquetSink(scratch(spark, "closed")))


@checked("SELECT event_id, true AS has_proctime, true AS in_run FROM events")
def stream_proctime(spark, sf):
    begin = spark.range(1).select(F.current_timestamp()).first()[0]
    rows = proctime(replay(spark, sf, "events")).select("event_id", "proctime")
    out = _run(spark, rows, ParquetSink(scratch(spark, "proctime")))
    return out.select("event_id", F.col("proctime").isNotNull().alias("has_proctime"),
                      F.col("proctime").between(F.lit(begin), F.current_timestamp()).alias("in_run"))


@checked(BUCKETED.format(keys="event_type", size="1 HOUR"))
def win_tumble(spark, sf):
    counts = _events(spark, sf).groupBy("event_type", tumble("rowtime", "1 hour")).agg(F.count("*").alias("cnt"))
    sink = ChangelogSink(scratch(spark, "tumble"), ["event_type", "window_start"])
    return _run(spark, counts.select("event_type", *bounds(), "cnt"), sink)


LABELLED = WINDOWED.format(key="event_type", size="5 SECOND")


def labelled_counts(rows):
    """Messages per key and five-second window, the window as text."""
    counts = rows.filter("key IS NOT NULL").groupBy("key", tumble("rowtime", "5 seconds")).agg(F.count("*").alias("cnt"))
    return counts.select("key", "cnt", label().alias("window_time"))


@checked(LABELLED)
def win_tumble_label(spark, sf):
    rows = _events(spark, sf, "5 seconds").withColumnRenamed("event_type", "key")
    return _run(spark, labelled_counts(rows), ChangelogSink(scratch(spark, "label"), ["key", "window_time"]))


@checked(LABELLED)
def win_tumble_batch(spark, sf):
    return labelled_counts(_events(spark, sf, "5 seconds", stream=False).withColumnRenamed("event_type", "key"))


HOPPING = """
    SELECT event_type, w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS cnt
    FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * i AS BIGINT)) AS w
          FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)) GROUP BY event_type, w
"""


@checked(HOPPING)
def win_hop(spark, sf):
    counts = _events(spark, sf).groupBy("event_type", hop("rowtime", "1 hour", "15 minutes")).agg(
        F.count("*").alias("cnt"))
    sink = ChangelogSink(scratch(spark, "hop"), ["event_type", "window_start"])
    return _run(spark, counts.select("event_type", *bounds(), "cnt"), sink)


@checked(HOPPING)
def win_hop_batch(spark, sf):
    out = hop_totals(table(spark, sf, "events"), ["event_type"], "ts", "1 hour", "15 minutes",
                     {"cnt": F.lit(1).cast("bigint")})
    return out.select("event_type", zoneless("window_start"), zoneless("window_end"), "cnt")


SESSIONS = """
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS cnt,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
        SELECT user_id, value, ts,
               CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
        FROM (SELECT user_id, value, {at} AS ts FROM events)))
    GROUP BY user_id, s
"""


@checked(SESSIONS.format(at="ts"))
def win_session(spark, sf):
    out = session_totals(table(spark, sf, "events"), ["user_id"], "ts", 30 * 60_000, {"total": cents("value")})
    return out.select("user_id", zoneless("session_start"), zoneless("session_end"), "cnt",
                      number(F.col("total")).alias("total"))


@checked(SESSIONS.format(at="ts") + """
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
""")
def stream_session(spark, sf):
    totals = _events(spark, sf).groupBy("user_id", session("rowtime", "30 minutes")).agg(
        F.count("*").alias("cnt"), F.sum(cents("value")).alias("total"))
    rows = totals.select("user_id", *bounds("session_window", "session_start", "session_end"), "cnt",
                         number(F.col("total")).alias("total"))
    return _run(spark, rows, ParquetSink(scratch(spark, "sessions")))


@checked(BUCKETED.format(keys="user_id", size="1 DAY"))
def stream_early_fire(spark, sf):
    # Partial results come every second; the newest one per window is the final one.
    job = Pipeline(spark)
    sink = ChangelogSink(scratch(spark, "early"), ["user_id", "window_start"])
    job.source(TableDef("feed", [("ts", "timestamp"), ("user_id", "bigint")], Watermark("ts", "5 seconds")),
               replay(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    job.sink(TableDef("out", [("user_id", "bigint"), ("window_start", "timestamp"), ("window_end", "timestamp"),
                              ("cnt", "bigint")]), sink)
    job.insert_into("out", """SELECT user_id, window.start, window.end, count(*) FROM feed
                              GROUP BY user_id, window(rowtime, '1 day')""", fire_every="1 second")
    for query in job.start():
        query.processAllAvailable()
        query.stop()
    return sink.read(spark).select("user_id", zoneless("window_start"), zoneless("window_end"), "cnt")


def _in_turn(spark, parts, query, sink):
    """Feed ``parts`` one after the other, restarting the query from its checkpoint each time."""
    feed, state = scratch(spark, "feed"), scratch(spark, "state")
    for part in parts:
        part.write.mode("append").parquet(feed)
        drain(query(spark.readStream.schema(part.schema).parquet(feed)), sink, state)
    return sink.read(spark)


def _late_errors(spark, sf, delay):
    """Hourly counts when all errors arrive after everything else."""
    events = table(spark, sf, "events").select("ts", "event_type")

    def hourly(stream):
        counts = event_time(stream, "ts", delay).groupBy(tumble("rowtime", "1 hour")).agg(
            F.count("*").alias("cnt"), F.count_if(F.col("event_type") == "error").alias("errors"))
        return counts.select(*bounds(), "cnt", "errors")

    parts = [events.filter("event_type <> 'error'"), events.filter("event_type = 'error'")]
    return _in_turn(spark, parts, hourly, ChangelogSink(scratch(spark, "late"), ["window_start"]))


LATE = """
    SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS cnt,
           count(*) FILTER (WHERE event_type = 'error') AS errors
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events)
    WHERE event_type <> 'error' OR w + INTERVAL 1 HOUR >
        (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {delay} FROM events WHERE event_type <> 'error')
    GROUP BY w
"""


@checked(LATE.format(delay="2 HOUR"))
def stream_late_rows(spark, sf):
    return _late_errors(spark, sf, "2 hours")


@checked(LATE.format(delay="10 DAY"))
def stream_lateness(spark, sf):
    return _late_errors(spark, sf, with_lateness("2 days", "8 days"))


@checked("SELECT user_id, count(*) AS cnt, true AS one_day FROM events GROUP BY user_id")
def stream_proc_window(spark, sf):
    counts = proctime(replay(spark, sf, "events")).groupBy("user_id", tumble("proctime", "1 day")).agg(
        F.count("*").alias("cnt"))
    sink = ChangelogSink(scratch(spark, "procwin"), ["user_id", "window_start"])
    out = _run(spark, counts.select("user_id", *bounds(), "cnt"), sink)
    day = F.col("window_end") == F.col("window_start") + F.expr("interval 1 day")
    return out.groupBy("user_id").agg(F.sum("cnt").alias("cnt"), F.every(day).alias("one_day"))


@checked("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id")
def stream_running_count(spark, sf):
    counts = replay(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cnt"))
    return _run(spark, counts, ChangelogSink(scratch(spark, "running"), ["user_id"]))


@checked("SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type ORDER BY cnt DESC, event_type LIMIT 3")
def stream_topk(spark, sf):
    counts = replay(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))
    top = counts.orderBy(F.col("cnt").desc(), "event_type").limit(3)
    return _run(spark, top, CompleteSink(scratch(spark, "top")))


@checked("""
    SELECT event_type, CAST(round(min(value) * 100) AS BIGINT) AS lo, CAST(round(max(value) * 100) AS BIGINT) AS hi,
           count(value) AS n
    FROM (SELECT event_type, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events) GROUP BY event_type
""")
def stream_keyed_state(spark, sf):
    rows = replay(spark, sf, "events").withColumn("value", F.expr("CASE WHEN event_id % 3 > 0 THEN value END"))
    states = running_state(rows, ["event_type"], "event_id", Spread(), ["value"])
    parts = _run(spark, states, ChangelogSink(scratch(spark, "keyed"), ["event_type", "part"]))
    return parts.groupBy("event_type").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


@checked("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    twice = _events(spark, sf).unionByName(_events(spark, sf))
    once = dedup(twice, ["event_id"])
    return _run(spark, once.select("event_id", "user_id", "event_type"), ParquetSink(scratch(spark, "dedup")))


@checked("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def stream_resume(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    parts = [orders.filter(F.col("o_orderstatus") == status) for status in ("F", "O", "P")]
    return _in_turn(spark, parts, lambda stream: stream.drop("o_orderstatus"), ParquetSink(scratch(spark, "resume")))


class _Repeated(Sink):
    """Writes each batch twice, as happens when a driver is lost between write and commit."""

    def __init__(self, inner):
        self.inner = inner

    def write(self, batch, batch_id):
        self.inner.write(batch, batch_id)
        self.inner.write(batch, batch_id)


@checked("SELECT event_type, user_id, count(*) AS cnt FROM events GROUP BY event_type, user_id")
def stream_idempotent_batch(spark, sf):
    inner = ParquetSink(scratch(spark, "idempotent"))
    drain(replay(spark, sf, "events").select("event_type", "user_id"), _Repeated(inner), scratch(spark, "state"))
    return inner.read(spark).groupBy("event_type", "user_id").agg(F.count("*").alias("cnt"))


@checked("""
    SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F'
""")
def join_stream_static(spark, sf):
    job, sink = Pipeline(spark), ParquetSink(scratch(spark, "lookup"))
    job.source(TableDef("order_stream", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"),
                                         ("o_orderstatus", "varchar")]), replay(spark, sf, "orders"))
    job.batch_table("dim_customer", table(spark, sf, "customer"))
    job.sink(TableDef("out", [("o_orderkey", "bigint"), ("o_totalprice", "double"), ("c_name", "varchar"),
                              ("c_mktsegment", "varchar")]), sink)
    job.insert_into("out", """SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM order_stream
                              JOIN dim_customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
    job.run()
    return sink.read(spark)


@checked("""
    SELECT c.user_id, c.event_id AS click_id, p.event_id AS buy_id
    FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase'
      AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR
""")
def stream_interval_join(spark, sf):
    clicks = event_time(replay(spark, sf, "events").filter("event_type = 'click'"), "ts", "1 hour", "click_ts").select(
        "user_id", F.col("event_id").alias("click_id"), "click_ts")
    buys = event_time(replay(spark, sf, "events").filter("event_type = 'purchase'"), "ts", "1 hour", "buy_ts").select(
        "user_id", F.col("event_id").alias("buy_id"), "buy_ts")
    pairs = interval_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", 6 * 3_600_000)
    return _run(spark, pairs.select("user_id", "click_id", "buy_id"), ParquetSink(scratch(spark, "pairs")))


def _side(spark, sf, kind, prefix):
    """Events of a kind with a watermark of their own, columns named for a join."""
    rows = event_time(replay(spark, sf, "events").filter(F.col("event_type") == kind), "ts", "1 hour", f"{prefix}_ts")
    return rows.select("user_id", F.col("event_id").alias(f"{prefix}_id"), f"{prefix}_ts", F.col("value").alias(f"{prefix}_value"))


# The watermark of two streams is that of the slower one.
CLOSED = """
    WITH mark AS (
        SELECT date_trunc('millisecond', least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = '{other}')))
               - INTERVAL 1 HOUR AS closed FROM events),
    c AS (SELECT user_id, event_id AS click_id, ts AS click_ts FROM events WHERE event_type = 'click'),
    p AS (SELECT user_id, event_id AS {name}_id, ts AS {name}_ts, value AS {name}_value FROM events WHERE event_type = '{other}')
"""


@checked(CLOSED.format(other="view", name="view") + """
    SELECT c.user_id, click_id, view_id, view_value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND click_ts >= view_ts
    WHERE click_ts <= (SELECT closed FROM mark)
""")
def stream_asof(spark, sf):
    # The last view of the user before each click, as soon as no earlier view can arrive.
    found = asof_stream(_side(spark, sf, "click", "click").drop("click_value"), _side(spark, sf, "view", "view"), ["user_id"],
                        "click_ts", "view_ts", {"view_id": "view_id", "view_value": "view_value"}, slot="5 days", ways=2)
    return _run(spark, found.drop("click_ts"), ParquetSink(scratch(spark, "asof")))


WITHIN = "c.user_id = p.user_id AND buy_ts >= click_ts AND buy_ts <= click_ts + INTERVAL 6 HOUR"
NULL_IDS = "CAST(NULL AS BIGINT)"
LEFT_CLOSED = f"""
    SELECT c.user_id, click_id, buy_id FROM c JOIN p ON {WITHIN}
    UNION ALL SELECT user_id, click_id, {NULL_IDS} FROM c
    WHERE click_ts + INTERVAL 6 HOUR <= (SELECT closed FROM mark) AND NOT EXISTS (SELECT 1 FROM p WHERE {WITHIN})
"""


def _bought(spark, sf, how):
    clicks, buys = _side(spark, sf, "click", "click"), _side(spark, sf, "purchase", "buy")
    rows = interval_join(clicks, buys, ["user_id"], "click_ts", "buy_ts", 6 * 3_600_000, how=how)
    return _run(spark, rows.select("user_id", "click_id", "buy_id"), ParquetSink(scratch(spark, "bought")))


@checked(CLOSED.format(other="purchase", name="buy") + LEFT_CLOSED)
def stream_left_interval(spark, sf):
    # Clicks without a purchase in the next six hours come once the watermark has passed those.
    return _bought(spark, sf, "left")


@checked(CLOSED.format(other="purchase", name="buy") + LEFT_CLOSED + f"""
    UNION ALL SELECT user_id, {NULL_IDS}, buy_id FROM p
    WHERE buy_ts <= (SELECT closed FROM mark) AND NOT EXISTS (SELECT 1 FROM c WHERE {WITHIN})
""")
def stream_full_interval(spark, sf):
    return _bought(spark, sf, "full")


class _NoPurchase(KeyedProcess):
    """Clicks without a purchase of their user in the half hour after them."""

    variables = {"clicks": Variable("map"), "bought": Variable("list"), "newest": Variable("value")}
    wait = 30 * 60 * 1_000_000

    def on_rows(self, key, rows, state):
        bought = []
        for row in rows:
            if row["event_type"] == "purchase":
                bought.append(row["rowtime"])
            else:
                state["clicks"].put(row["event_id"], row["rowtime"])
                state.wake(row["rowtime"] + self.wait)
        if bought:
            state["bought"].append(*bought)
            state["newest"].put(max([*bought, state["newest"].get(0)]))
        return ()

    def on_timer(self, key, at, state):
        due = [(event, clicked) for event, clicked in state["clicks"].items() if clicked + self.wait <= state.now]
        bought = list(state["bought"])
        for event, clicked in due:
            state["clicks"].remove(event)
            if not any(clicked <= b <= clicked + self.wait for b in bought):
                yield {"user_id": key["user_id"], "event_id": event}
        # clicks that are left, or still to come, are less than half an hour behind the watermark
        since = state.now - self.wait
        if state["newest"].get(0) < since:
            state["bought"].clear()
        elif len(bought) != len(left := [b for b in bought if b >= since]):
            state["bought"].put(left)


@checked("""
    WITH mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS closed FROM events
                  WHERE event_type IN ('click', 'purchase'))
    SELECT user_id, event_id FROM events c WHERE event_type = 'click' AND ts + INTERVAL 30 MINUTE <= (SELECT closed FROM mark)
      AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = c.user_id AND p.event_type = 'purchase'
                      AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 30 MINUTE)
""")
def stream_timers(spark, sf):
    rows = _events(spark, sf).filter("event_type IN ('click', 'purchase')").select("user_id", "event_id", "event_type", "rowtime")
    alone = keyed_process(rows, ["user_id"], _NoPurchase(), "user_id long, event_id long", at="rowtime")
    return _run(spark, alone, ParquetSink(scratch(spark, "alone")))


@checked("""
    SELECT event_id, event_type, event_type = 'error' AND ts <=
        (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events WHERE event_type <> 'error') AS late
    FROM events
""")
def stream_late_side(spark, sf):
    # All errors arrive after everything else; those behind the watermark go to a table of their own.
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    kept, late = (ParquetSink(scratch(spark, name)) for name in ("kept", "side"))
    split = LateSplit("ts", "2 hours", kept, late, scratch(spark, "marks"))
    parts = [events.filter("event_type <> 'error'"), events.filter("event_type = 'error'")]
    return _in_turn(spark, parts, lambda stream: stream, split).select("event_id", "event_type", "late")


def _set_changes(spark, sf, kind):
    """Customers and states of dear orders against those of urgent ones, row by row in three parts."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderkey")
    parts = [orders.filter(F.col("o_orderkey") % 3 == n) for n in (2, 0, 1)]

    def query(stream):
        pick = lambda cond: stream.filter(cond).select("o_custkey", "o_orderstatus")
        return set_changes(pick("o_totalprice > 100000"), pick("o_orderpriority LIKE '1%'"), kind)

    log = _in_turn(spark, parts, query, ParquetSink(scratch(spark, "sets")))
    net = log.groupBy("o_custkey", "o_orderstatus").agg(F.sum("sign").alias("n")).filter("n > 0")
    return net.select("o_custkey", "o_orderstatus", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


SET_SQL = """
    SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000
    {kind} SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%'
"""


@checked(SET_SQL.format(kind="EXCEPT ALL"))
def stream_except_all(spark, sf):
    return _set_changes(spark, sf, "except all")


@checked(SET_SQL.format(kind="INTERSECT ALL"))
def stream_intersect_all(spark, sf):
    return _set_changes(spark, sf, "intersect all")


@checked("""
    SELECT event_type, w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(DISTINCT user_id) AS users
    FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM events) GROUP BY event_type, w
    HAVING w + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
""")
def stream_distinct(spark, sf):
    counts = distinct_counts(_events(spark, sf), ["event_type"], "user_id", "rowtime", "6 hours", "users")
    return _run(spark, counts.select("event_type", *bounds(), "users"), ParquetSink(scratch(spark, "distinct")))


@checked("""
    SELECT event_type, w - i * INTERVAL 1 HOUR AS window_start, count(DISTINCT user_id) AS users, true AS close
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events), (SELECT unnest(range(0, 6)) AS i) GROUP BY ALL
""")
def stream_distinct_sketch(spark, sf):
    # Sketches of an hour unite to windows of six; the exact counts beside them hold the estimates to 5 %.
    panes = distinct_sketches(_events(spark, sf), ["event_type"], "user_id", "rowtime", "1 hour")
    sink = ChangelogSink(scratch(spark, "panes"), ["event_type", "window_start"])
    known = _run(spark, panes.select("event_type", F.col("window.start").alias("window_start"), "sketch"), sink)
    near = united(known, ["event_type"], "1 hour", "6 hours", "about")
    exact = _events(spark, sf, stream=False).groupBy("event_type", hop("rowtime", "6 hours", "1 hour")).agg(
        F.count_distinct("user_id").alias("users"))
    both = exact.select("event_type", F.col("window.start").alias("window_start"), "users").join(near, ["event_type", "window_start"], "full")
    close = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.05)
    return both.select("event_type", zoneless("window_start"), "users", F.coalesce(close, F.lit(False)).alias("close"))


def _come_and_go(rows, gone):
    """All rows come, those of ``gone`` go again, as (order of arrival, sign)."""
    back = rows.filter(gone).withColumn("sign", F.lit(-1))
    return [rows.withColumn("sign", F.lit(1)).withColumn("step", F.lit(0)), back.withColumn("step", F.lit(1))]


@checked("""
    SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_nationkey <> 3
""")
def stream_retract_join(spark, sf):
    # Orders and customers come in turns; then finished orders and the customers of one nation are taken back.
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice", F.lit(None).cast("string").alias("c_mktsegment"),
        (F.col("o_orderstatus") == "F").alias("gone"), F.lit("order").alias("side"))
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"),
        "c_mktsegment", (F.col("c_nationkey") == 3).alias("gone"), F.lit("customer").alias("side"))
    (first, first_back), (second, second_back) = (_come_and_go(rows, F.col("gone")) for rows in (orders, customers))
    parts = [p.drop("step", "gone") for p in (first, second.unionByName(first_back), second_back)]

    def joined(stream):
        left = stream.filter("side = 'order'").select("key", "o_orderkey", "o_totalprice", "sign")
        return join_changes(left, stream.filter("side = 'customer'").select("key", "c_mktsegment", "sign"), ["key"], ways=2)

    out = _in_turn(spark, parts, joined, ParquetSink(scratch(spark, "changes")))
    net = out.groupBy(F.col("key").alias("o_custkey"), "o_orderkey", "o_totalprice", "c_mktsegment").agg(F.sum("sign").alias("n"))
    return net.filter("n > 0").drop("n")


@checked("""
    SELECT o_custkey, rank, o_orderkey, CAST(cents AS BIGINT) AS cents FROM (
        SELECT o_custkey, o_orderkey, round(o_totalprice * 100) AS cents, CAST(row_number() OVER (
            PARTITION BY o_custkey ORDER BY round(o_totalprice * 100) DESC, o_orderkey) AS INTEGER) AS rank
        FROM orders WHERE o_orderstatus <> 'F') WHERE rank <= 3
""")
def stream_topk_per_group(spark, sf):
    # The three dearest orders of each customer; finished orders are taken back, and others move up.
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_orderstatus")
    parts = [p.drop("step", "o_orderstatus") for p in _come_and_go(orders, F.col("o_orderstatus") == "F")]
    log = _in_turn(spark, parts, lambda s: topk_changes(s, ["o_custkey"], "cents", 3, "o_orderkey", sign="sign", width=10_000_000),
                   ParquetSink(scratch(spark, "ranks")))
    net = log.groupBy("o_custkey", "rank", "o_orderkey", "cents").agg(F.sum("sign").alias("n"))
    return net.filter("n > 0").drop("n")


@checked("""
    SELECT o_custkey, count(*) AS cnt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey
""")
def stream_retract(spark, sf):
    # All but open orders are taken back in later batches; customers without open orders vanish.
    orders = table(spark, sf, "orders").select("o_custkey", cents("o_totalprice").alias("total"), "o_orderstatus")
    back = orders.withColumn("sign", F.lit(-1))
    parts = [orders.withColumn("sign", F.lit(1))] + [back.filter(F.col("o_orderstatus") == s) for s in ("F", "P")]
    sink = ChangelogSink(scratch(spark, "retract"), ["o_custkey"], deleted="gone", compact_every=2)
    out = _in_turn(spark, parts, lambda s: net_changes(s, ["o_custkey"], "sign", {"total": "total"}, gone="gone"), sink)
    return out.select("o_custkey", "cnt", number(F.col("total")).alias("total"))


@checked("""
    SELECT event_type, w - i * INTERVAL 2 MINUTE AS window_start, w - i * INTERVAL 2 MINUTE + INTERVAL 10 MINUTE AS window_end,
           CAST(sum(round(value * 100)) AS BIGINT) AS total
    FROM (SELECT *, time_bucket(INTERVAL 2 MINUTE, ts) AS w FROM events), (SELECT unnest(range(0, 5)) AS i)
    WHERE epoch_us(w - i * INTERVAL 2 MINUTE) % 240000000 = 0
    GROUP BY ALL
""")
def win_hop_uneven(spark, sf):
    # Ten minutes every four: no window edge may cut a pane.
    worth = F.round(F.col("value") * 100).cast("bigint")
    totals = hop_totals(table(spark, sf, "events"), ["event_type"], "ts", "10 minutes", "4 minutes", {"total": worth})
    return totals.select("event_type", zoneless("window_start"), zoneless("window_end"), "total")
