"""Stream processing: the same tables, read as streams and run until all input is processed.

Each query works in a fresh folder below the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide import streaming as st
from rowtide.functions.clock import micros, seconds
from rowtide.operators import apply as ap
from rowtide.operators import windows as win
from rowtide.plans.alerting import _chain
from rowtide.plans.logs import orders as read_orders
from rowtide.plans.logs import ORDER_COLS, ORIGIN_US, events_log, orders_log, scrape, sec, sql
from rowtide.plans.merge import ORACLE as MERGE_ORACLE
from rowtide.sources.tables import read_table, run_dir, stream_table
from rowtide.sources.versions import read_state
from rowtide.streaming.jobs import event_time
from rowtide.streaming.state import keyed_state
from rowtide.streaming.state import stream_upsert_state as keyed_upsert

def _aggs():
    return {"n": F.count("*"), "cents": F.sum("cents")}


def _events(spark, root, stream=True):
    ev = stream_table(spark, root, "events") if stream else read_table(spark, root, "events")
    cents = F.round(F.col("value") * 100, 0).cast("bigint")
    return event_time(ev.select("event_id", "ts", "user_id", "event_type", cents.alias("cents")))


def _windowed(window, slide=None):
    def run(spark, root):
        agg = st.window_agg(_events(spark, root), window, ["event_type"], _aggs(), "1 hour", slide)
        d = run_dir(spark, "windows")
        st.update_sink(agg, f"{d}/out", f"{d}/checkpoint")
        out = st.latest_epoch(spark, f"{d}/out", ["window_start", "window_end", "event_type"])
        return out.select(sec("window_start").alias("sec"), "event_type", "n", "cents")
    return run


GAP_S = 3 * 3600


def session(spark, root):
    """Sessions per user with a gap of three hours, over the whole table."""
    ev = _events(spark, root, stream=False)
    out = win.merge_runs(ev, ["user_id"], micros(F.col("ts")), seconds(GAP_S), {"cents": ("sum", "cents")})
    return out.select("user_id", (F.col("start_us") - ORIGIN_US).alias("start_us"),
                      (F.col("end_us") - ORIGIN_US).alias("end_us"), "rows", "cents")


def session_stream(spark, root):
    """The same sessions while the stream runs: those the watermark has closed."""
    agg = st.session_agg(_events(spark, root), f"{GAP_S} seconds", ["user_id"], _aggs(), "10 minutes")
    d = run_dir(spark, "sessions")
    st.run_now(agg, f"{d}/out", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/out").select(
        "user_id", (micros(F.col("session_start")) - ORIGIN_US).alias("start_us"), "n", "cents")


HALF_HOUR = 1800


def interval_join(spark, root):
    """Purchases within half an hour after a click of the same user."""
    ev = _events(spark, root, stream=False)
    a = ev.filter(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("ta"))
    b = ev.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("tb"))
    out = win.interval_join(a, b, ["user_id"], micros(F.col("ta")), micros(F.col("tb")), 0, seconds(HALF_HOUR))
    return out.select("user_id", "click", "purchase")


def interval_join_outer(spark, root):
    """The same with clicks that led to nothing and purchases without a click."""
    ev = _events(spark, root, stream=False)
    a = ev.filter(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("ta"))
    b = ev.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("tb"))
    out = win.interval_join(a, b, ["user_id"], micros(F.col("ta")), micros(F.col("tb")), 0, seconds(HALF_HOUR), "full")
    return out.select("user_id", "click", "purchase")


def interval_join_stream(spark, root):
    ev = _events(spark, root)
    a = ev.filter(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("ta"))
    ev2 = _events(spark, root)
    b = ev2.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("tb"))
    pairs = st.interval_join_stream(a, b, ["user_id"], "ta", "tb", "0 seconds", f"{HALF_HOUR} seconds", "1 hour")
    d = run_dir(spark, "interval-join")
    st.run_now(pairs.select("a.user_id", "click", "purchase"), f"{d}/out", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/out")


def asof_join(spark, root):
    """Each purchase with the same user's last click before it."""
    ev = _events(spark, root, stream=False)
    left = ev.filter(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("purchase"), "ts")
    right = ev.filter(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("click"), "ts")
    out = win.asof_join(left, right, ["user_id"], micros(F.col("ts")), micros(F.col("ts")), ["click"])
    return out.select("user_id", "purchase", "click")


def stream_dedupe(spark, root):
    """Every fifth event delivered twice; one row per event is left."""
    ev = _events(spark, root)
    twice = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = ev.withColumn("copy", F.explode(twice))
    d = run_dir(spark, "dedupe")
    st.run_now(st.dedupe_stream(doubled, ["event_id"], "1 hour").drop("copy"), f"{d}/out", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/out").select("event_id", "user_id", "event_type", "cents")


def enrich_stream(spark, root):
    cust = read_table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    d = run_dir(spark, "enrich")
    st.run_now(st.enrich(_events(spark, root), cust, ["user_id"]), f"{d}/out", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/out").select("event_id", "user_id", "c_mktsegment")


def pass_through(spark, root):
    d = run_dir(spark, "pass-through")
    st.run_now(_events(spark, root).filter(F.col("event_type") != "view"), f"{d}/out", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/out").select("event_id", "event_type", "cents")


def _stream_upsert(deletes):
    def run(spark, root):
        d = run_dir(spark, "state")
        log = orders_log(spark, root, stream_table(spark, root, "orders"))
        st.stream_upsert(log, f"{d}/orders", ["o_orderkey"], 16, f"{d}/checkpoint", f"{d}/staging", deletes)
        return ap.live(read_state(spark, f"{d}/orders")).select(*ORDER_COLS)
    return run


def stream_replay(spark, root):
    """Two streams write to one table, each with a checkpoint of its own: the newer half of the log
    first, the older half after it, and then the older half once more, with its checkpoint lost."""
    d = run_dir(spark, "state")
    for n, older in enumerate((False, True, True)):
        log = orders_log(spark, root, stream_table(spark, root, "orders"))
        part = log.filter((F.col("source.lsn") < 20) if older else (F.col("source.lsn") >= 20))
        st.stream_upsert(part, f"{d}/orders", ["o_orderkey"], 8, f"{d}/checkpoint-{n}", f"{d}/staging-{older}", "apply")
    return ap.live(read_state(spark, f"{d}/orders")).select(*ORDER_COLS)


def stream_upsert_state(spark, root):
    """The same with the state inside the stream, which begins with a snapshot of the orders."""
    log = orders_log(spark, root, stream_table(spark, root, "orders"))
    snapshot = ap.as_state(read_orders(spark, root), lsn=0, schema_version=2)
    d = run_dir(spark, "keyed")
    with keyed_state(spark):
        st.update_sink(keyed_upsert(log.filter(F.col("source.lsn") > 0), ["o_orderkey"], "apply", snapshot), f"{d}/out", f"{d}/checkpoint")
    changed = st.latest_epoch(spark, f"{d}/out", ["o_orderkey"])
    kept = snapshot.join(changed, "o_orderkey", "left_anti").select(*changed.columns)
    return ap.live(changed.unionByName(kept)).select(*ORDER_COLS)


def stream_hold(spark, root):
    """Targets down for two minutes, found while the stream runs."""
    up = scrape(spark, root, ["up"], stream_table(spark, root, "events"))
    flags = up.select(
        F.lit("TargetDown").alias("alertname"), F.col("labels")["node"].alias("node"),
        F.col("labels")["instance"].alias("series"), F.lit(120).alias("for_s"), "ts",
        (F.col("value") == 0).alias("active"))
    d = run_dir(spark, "hold")
    st.run_now(st.stream_hold(flags, 15, "10 minutes"), f"{d}/out", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/out").select("alertname", "node", "series", sec("at").alias("sec"), "state")


def event_lag_stream(spark, root):
    """Summed arrival lag and number of events per hour of the change log, while the stream runs."""
    ev = events_log(spark, root, stream_table(spark, root, "events"))
    lag = event_time(ev.select("ts", "partition", ((micros(F.col("ts")) - micros(F.col("source.ts"))) / 1000).cast("bigint").alias("lag")))
    agg = st.window_agg(lag, "1 hour", ["partition"], {"events": F.count("*"), "lag_ms": F.sum("lag")}, "1 hour")
    d = run_dir(spark, "lag")
    st.update_sink(agg, f"{d}/out", f"{d}/checkpoint")
    out = st.latest_epoch(spark, f"{d}/out", ["window_start", "window_end", "partition"])
    return out.select(sec("window_start").alias("sec"), "partition", "events", "lag_ms")


QUERIES = {
    "tumbling": _windowed("1 hour"),
    "sliding": _windowed("1 hour", "15 minutes"),
    "session": session,
    "session_stream": session_stream,
    "interval_join": interval_join,
    "interval_join_outer": interval_join_outer,
    "interval_join_stream": interval_join_stream,
    "asof_join": asof_join,
    "stream_dedupe": stream_dedupe,
    "enrich_stream": enrich_stream,
    "pass_through": pass_through,
    "stream_upsert": _stream_upsert("drop"),
    "stream_upsert_apply": _stream_upsert("apply"),
    "stream_replay": stream_replay,
    "stream_upsert_state": stream_upsert_state,
    "stream_hold": stream_hold,
    "event_lag_stream": event_lag_stream,
}

_E = f"SELECT *, epoch_us(ts) - {ORIGIN_US} AS us, CAST(round(value * 100, 0) AS BIGINT) AS cents FROM events"
_SESSIONS = f"""
    SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS "rows", CAST(sum(cents) AS BIGINT) AS cents
    FROM (SELECT *, sum(CASE WHEN p IS NULL OR us - p > {GAP_S * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS run
          FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS p FROM e)) GROUP BY user_id, run"""
_PAIRS = f"""
    SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click'
    AND b.event_type = 'purchase' AND b.us BETWEEN a.us AND a.us + {HALF_HOUR * 1000000}"""

ORACLE = {
    "tumbling": sql(
        "SELECT CAST(us // 3600000000 * 3600 AS BIGINT) AS sec, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents "
        "FROM e GROUP BY 1, 2", e=_E),
    "sliding": sql(
        "SELECT CAST((us // 900000000 - o) * 900 AS BIGINT) AS sec, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents "
        "FROM e, (VALUES (0), (1), (2), (3)) v(o) GROUP BY 1, 2", e=_E),
    "session": sql(_SESSIONS, e=_E),
    "session_stream": sql(
        'SELECT user_id, start_us, "rows" AS n, cents FROM x WHERE end_us + '
        f"{GAP_S * 1000000} <= (SELECT max(us) FROM e) // 1000 * 1000 - 600000000", e=_E, x=_SESSIONS),
    "interval_join_outer": sql("""
        SELECT * FROM p UNION ALL SELECT user_id, event_id, NULL FROM e WHERE event_type = 'click' AND event_id NOT IN (SELECT click FROM p)
        UNION ALL SELECT user_id, NULL, event_id FROM e WHERE event_type = 'purchase' AND event_id NOT IN (SELECT purchase FROM p)""",
                               e=_E, p=_PAIRS),
    "interval_join": sql(_PAIRS, e=_E),
    "interval_join_stream": sql(_PAIRS, e=_E),
    "asof_join": sql("""
        SELECT a.user_id, a.event_id AS purchase, b.event_id AS click FROM (SELECT * FROM e WHERE event_type = 'purchase') a
        ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.us >= b.us""", e=_E),
    "stream_dedupe": sql("SELECT event_id, user_id, event_type, cents FROM e", e=_E),
    "enrich_stream": (
        "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey"),
    "pass_through": sql("SELECT event_id, event_type, cents FROM e WHERE event_type <> 'view'", e=_E),
    "stream_upsert": MERGE_ORACLE["upsert_drop_deletes"],
    "stream_upsert_apply": MERGE_ORACLE["upsert_apply_deletes"],
    "stream_replay": MERGE_ORACLE["upsert_apply_deletes"],
    "stream_upsert_state": MERGE_ORACLE["upsert_apply_deletes"],
    "stream_hold": _chain("""
        SELECT 'TargetDown' AS alertname, node, instance AS series, sec, state FROM (
          SELECT node, instance, unnest([{'sec': a + 120, 'state': 'firing'}, {'sec': b, 'state': 'resolved'}], recursive := true)
                 , b, last FROM (
            SELECT node, instance, min(sec) AS a, max(sec) AS b, any_value(last) AS last FROM (
              SELECT *, sum(CASE WHEN p IS NULL OR sec - p > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY sec) AS run
              FROM (SELECT *, lag(sec) OVER (PARTITION BY series ORDER BY sec) AS p
                    FROM (SELECT *, max(sec) OVER (PARTITION BY series) AS last FROM s WHERE metric = 'up') WHERE value = 0))
            GROUP BY node, instance, series, run) WHERE b - a >= 120)
        WHERE state = 'firing' OR b < last"""),
    "event_lag_stream": sql(f"""
        SELECT CAST((epoch_us(date_trunc('hour', ts)) - {ORIGIN_US}) // 1000000 AS BIGINT) AS sec, CAST(part AS INTEGER) AS partition,
               count(*) AS events, CAST(sum(event_id % 7 * 1000) AS BIGINT) AS lag_ms FROM events_log GROUP BY 1, 2""", "events_log"),
}
