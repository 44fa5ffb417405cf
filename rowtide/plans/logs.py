"""Change logs, dead letters and samples derived from the benchmark tables.

Each is derived row by row (one scan, no shuffle), so it grows with its table; the SQL next to it
is the same definition for the SQL side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.sources.changes import source_struct
from rowtide.sources.tables import read_table

TOPIC = "sqlserver.shop.dbo.orders"
NEW_KEY = 1_000_000_000_000
STRIDE = 10_000_000_000_000
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "orders")


def _image(changed: dict[str, str] | None) -> str:
    if changed is None:
        return f"CAST(NULL AS STRUCT<{_ORDER_TYPES}>)"
    return "named_struct(" + ", ".join(f"'{c}', {changed.get(c, c)}" for c in ORDER_COLS) + ")"


_ORDER_TYPES = (
    "o_orderkey: BIGINT, o_custkey: BIGINT, o_orderstatus: STRING, o_totalprice: DOUBLE, o_orderdate: TIMESTAMP_NTZ, "
    "o_orderpriority: STRING"
)
# lsn, op, key, condition, row before, row after; a row is the order with some values changed
_ORDER_EVENTS = [
    (0, "'r'", "o_orderkey", "true", None, {}),
    (10, "'u'", "o_orderkey", "o_orderkey % 3 = 0", {}, {"o_orderstatus": "'U'"}),
    (10, "'u'", "o_orderkey", "o_orderkey % 21 = 0", {}, {"o_orderstatus": "'U'"}),
    (20, "'u'", "o_orderkey", "o_orderkey % 6 = 0", {"o_orderstatus": "'U'"},
     {"o_orderstatus": "'U'", "o_totalprice": "o_totalprice + 1.0D"}),
    (30, "'d'", "o_orderkey", "o_orderkey % 10 = 0", {}, None),
    (31, "CAST(NULL AS STRING)", "o_orderkey", "o_orderkey % 10 = 0", None, None),
    (40, "'c'", "o_orderkey", "o_orderkey % 20 = 0", None, {"o_orderstatus": "'R'"}),
    (50, "'c'", f"o_orderkey + {NEW_KEY}", "o_orderkey % 11 = 0", None, {"o_orderkey": f"o_orderkey + {NEW_KEY}"}),
]


def orders_log(spark: SparkSession, root: str, df: DataFrame | None = None) -> DataFrame:
    """Snapshot of ``orders`` (or ``df``, its stream) and changes to it, with redeliveries and
    tombstones."""
    df = orders(spark, root) if df is None else df
    entries = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('lsn', {lsn}L, 'op', {op}, 'k', {key}, 'before', {_image(before)}, "
        f"'after', {_image(after)}) END"
        for lsn, op, key, cond, before, after in _ORDER_EVENTS
    )
    flat = df.selectExpr("o_orderdate", f"inline(array_compact(array({entries})))")
    return flat.selectExpr(
        f"'{TOPIC}' AS topic", "CAST(k % 3 AS INT) AS partition", f"lsn * {STRIDE} + k AS offset",
        "o_orderdate + make_dt_interval(0, 0, 0, lsn) AS ts", "named_struct('o_orderkey', k) AS key",
        "op", "before", "after",
        "named_struct('db', 'shop', 'schema', 'dbo', 'table', 'orders', 'lsn', lsn, 'seq', 0L, 'ts', o_orderdate, "
        "'snapshot', false) AS source",
        "IF(k % 4 = 0, map('__origin', 'site_a', 'trace', 't'), NULL) AS headers", "2 AS schema_version",
    )


# columns: k, lsn, op, offs, part, home (has the origin header), then the new image
_ORDERS_LOG_ROWS = [
    ("0", "'r'", "o_orderkey", "true", {}),
    ("10", "'u'", "o_orderkey", "o_orderkey % 3 = 0", {"o_orderstatus": "'U'"}),
    ("10", "'u'", "o_orderkey", "o_orderkey % 21 = 0", {"o_orderstatus": "'U'"}),
    ("20", "'u'", "o_orderkey", "o_orderkey % 6 = 0",
     {"o_orderstatus": "'U'", "o_totalprice": "o_totalprice + 1.0"}),
    ("30", "'d'", "o_orderkey", "o_orderkey % 10 = 0", None),
    ("31", "NULL", "o_orderkey", "o_orderkey % 10 = 0", None),
    ("40", "'c'", "o_orderkey", "o_orderkey % 20 = 0", {"o_orderstatus": "'R'"}),
    ("50", "'c'", f"o_orderkey + {NEW_KEY}", "o_orderkey % 11 = 0", {"o_orderkey": f"o_orderkey + {NEW_KEY}"}),
]


def _orders_log_sql() -> str:
    parts = []
    for lsn, op, key, cond, changed in _ORDERS_LOG_ROWS:
        cols = []
        for c in ORDER_COLS:
            value = "NULL" if changed is None else changed.get(c, c)
            cols.append(f"{value} AS {c}")
        parts.append(
            f"SELECT CAST({key} AS BIGINT) AS k, CAST({lsn} AS BIGINT) AS lsn, CAST({op} AS VARCHAR) AS op, "
            f"o_orderdate AS src_ts, {', '.join(cols)} FROM orders WHERE {cond}"
        )
    union = " UNION ALL ".join(parts)
    return (
        f"SELECT *, lsn * {STRIDE} + k AS offs, k % 3 AS part, k % 4 = 0 AS home, "
        f"src_ts + to_seconds(lsn) AS ts FROM ({union})"
    )


def events_log(spark: SparkSession, root: str, df: DataFrame | None = None) -> DataFrame:
    """User activity as change events; arrival is 0 to 6 seconds after the event."""
    ev = read_table(spark, root, "events") if df is None else df
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    topic = "sqlserver.shop.dbo.activity"
    return ev.select(
        F.lit(topic).alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 7)).alias("ts"),
        F.struct("user_id").alias("key"),
        op.alias("op"),
        F.struct("user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("after"),
        source_struct(topic, F.col("event_id"), F.col("ts"), False).alias("source"),
    )


EVENTS_LOG = (
    "SELECT user_id, event_id, ts AS src_ts, ts + to_seconds(event_id % 7) AS ts, user_id % 4 AS part, event_type, value, "
    "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op FROM events"
)


def mixed_log(spark: SparkSession, root: str) -> DataFrame:
    """One log with the changes of three tables, values as JSON text, plus a few other topics."""
    def part(df: DataFrame, topic: str, key: str, lsn: int, op: str, cond: Column, cols: list[Column]) -> DataFrame:
        value = F.to_json(F.struct(*cols)) if cols else F.lit(None).cast("string")
        k = F.col(key).cast("bigint")
        return df.filter(cond).select(
            F.lit(topic).alias("topic"), (k % 3).cast("int").alias("partition"),
            (F.lit(lsn).cast("bigint") * F.lit(STRIDE) + k).alias("offset"),
            F.lit(lsn).cast("bigint").alias("lsn"), F.lit(op).cast("string").alias("op"),
            k.cast("string").alias("key"), value.alias("value"),
        )

    cust, supp = read_table(spark, root, "customer"), read_table(spark, root, "supplier")
    items, every = read_table(spark, root, "part"), F.lit(True)
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")

    def person(prefix: str, bal: Column) -> list[Column]:
        return [F.col(f"{prefix}_name").alias("name"), bal.alias("bal")]

    frames = [
        part(cust, "sqlserver.shop.dbo.customer", "c_custkey", 0, "r", every, person("c", F.col("c_acctbal"))),
        part(cust, "sqlserver.shop.dbo.customer", "c_custkey", 10, "u", c % 4 == 0,
             person("c", F.col("c_acctbal") + 1.0)),
        part(cust, "sqlserver.shop.dbo.customer", "c_custkey", 20, "d", c % 9 == 0, []),
        part(supp, "aurora.public.supplier", "s_suppkey", 0, "r", every, person("s", F.col("s_acctbal"))),
        part(supp, "aurora.public.supplier", "s_suppkey", 20, "d", s % 5 == 0, []),
        part(items, "sqlserver.shop.sales.part", "p_partkey", 0, "r", every,
             [F.col("p_name").alias("name"), F.col("p_size").alias("size")]),
        part(items, "sqlserver.shop.sales.part", "p_partkey", 10, "u", p % 3 == 0,
             [F.col("p_name").alias("name"), (F.col("p_size") + 1).alias("size")]),
        part(cust, "dlq-sink-forward", "c_custkey", 30, "c", c % 50 == 0, person("c", F.col("c_acctbal"))),
        part(supp, "_schema-history-shop", "s_suppkey", 30, "c", s % 20 == 0, person("s", F.col("s_acctbal"))),
        part(items, "connect-forward-offsets", "p_partkey", 30, "c", p % 100 == 0, [F.col("p_name").alias("name")]),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _mixed_sql() -> str:
    def part(topic: str, table: str, key: str, lsn: int, op: str, cond: str, name: str, num: str) -> str:
        return (
            f"SELECT '{topic}' AS topic, {key} % 3 AS part, {lsn} * {STRIDE} + {key} AS offs, {lsn} AS lsn, "
            f"'{op}' AS op, CAST({key} AS VARCHAR) AS key, {name} AS name, CAST({num} AS DOUBLE) AS num "
            f"FROM {table} WHERE {cond}"
        )

    cust, supp, item = "sqlserver.shop.dbo.customer", "aurora.public.supplier", "sqlserver.shop.sales.part"
    return " UNION ALL ".join([
        part(cust, "customer", "c_custkey", 0, "r", "true", "c_name", "c_acctbal"),
        part(cust, "customer", "c_custkey", 10, "u", "c_custkey % 4 = 0", "c_name", "c_acctbal + 1.0"),
        part(cust, "customer", "c_custkey", 20, "d", "c_custkey % 9 = 0", "NULL", "NULL"),
        part(supp, "supplier", "s_suppkey", 0, "r", "true", "s_name", "s_acctbal"),
        part(supp, "supplier", "s_suppkey", 20, "d", "s_suppkey % 5 = 0", "NULL", "NULL"),
        part(item, "part", "p_partkey", 0, "r", "true", "p_name", "p_size"),
        part(item, "part", "p_partkey", 10, "u", "p_partkey % 3 = 0", "p_name", "p_size + 1"),
        part("dlq-sink-forward", "customer", "c_custkey", 30, "c", "c_custkey % 50 = 0", "c_name", "c_acctbal"),
        part("_schema-history-shop", "supplier", "s_suppkey", 30, "c", "s_suppkey % 20 = 0", "s_name", "s_acctbal"),
        part("connect-forward-offsets", "part", "p_partkey", 30, "c", "p_partkey % 100 = 0", "p_name", "NULL"),
    ])


def document_log(spark: SparkSession, root: str) -> DataFrame:
    """Documents as the records of one topic per source, ten minutes apart."""
    d = read_table(spark, root, "documents")
    at = F.timestamp_micros(F.col("doc_id") * 600_000_000 + ORIGIN_US).cast("timestamp_ntz")
    return d.select(
        F.col("source").alias("topic"), (F.col("doc_id") % 2).cast("int").alias("partition"),
        F.col("doc_id").alias("offset"), at.alias("ts"), F.col("text").alias("value"),
    )


ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00
DOCUMENT_LOG = (
    "SELECT source AS topic, doc_id % 2 AS part, doc_id AS offs, "
    "TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10) AS ts, CAST(strlen(text) AS BIGINT) AS size, text FROM documents"
)


def dirty_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders as they may arrive: a price that is no number, a missing key, an overlong status."""
    k = F.col("o_orderkey")
    return orders(spark, root).select(
        F.lit(TOPIC).alias("topic"), (k % 3).cast("int").alias("partition"), k.alias("offset"),
        F.when(k % 101 != 0, k).alias("o_orderkey"),
        F.when(k % 97 == 0, "N/A").otherwise(F.round(F.col("o_totalprice") * 100, 0).cast("bigint").cast("string")).alias("price"),
        F.when(k % 103 == 0, F.concat(F.lit("status-far-too-long-"), F.col("o_orderstatus")))
        .otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 89 == 0, 1).otherwise(2).alias("schema_version"),
    )


DIRTY_ORDERS = (
    "SELECT o_orderkey AS offs, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderkey END AS o_orderkey, "
    "CASE WHEN o_orderkey % 97 = 0 THEN 'N/A' ELSE CAST(CAST(round(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR) END AS price, "
    "CASE WHEN o_orderkey % 103 = 0 THEN 'status-far-too-long-' || o_orderstatus ELSE o_orderstatus END AS status "
    "FROM orders"
)

# Metric samples on a 15 s grid. Row i of ``events`` is target ``g = i % 8`` at grid point
# ``tick``; ``v`` is its value in whole units. Each entry is metric, labels, value, condition, in
# expressions that mean the same in both dialects.
SCRAPE = [
    ("debezium_metrics_milliseconds_behind_source",
     {"connector": "concat('c', g)", "context": "'streaming'", "node": "concat('node-', g % 4)"},
     "case when g = 3 and (tick - tick % 200) / 200 % 5 = 0 then 400000 "
     "when (tick - tick % 30) / 30 % 3 = 0 then 2000 + v else v end", "true"),
    ("kafka_server_brokertopicmetrics_messagesinpersec",
     {"topic": "concat('sqlserver.shop.dbo.t', g)", "node": "concat('node-', g % 4)"},
     "((tick - tick % 200) / 200 * 280 + least(tick % 200, 40) * 7) % 700", "true"),
    ("kafka_server_brokertopicmetrics_messagesinpersec",
     {"topic": "case when g = 0 then 'dlq-sink-forward' else 'dlq-sink-reverse' end", "node": "concat('node-', g % 4)"},
     "case when tick % 400 < 100 then tick * 20 else (tick - tick % 50) / 50 end", "g < 2"),
    ("up",
     {"job": "case when g < 3 then 'kafka-brokers' when g < 5 then 'kafka-connect' else 'node-exporter' end",
      "instance": "concat('i', g)", "node": "concat('node-', g % 4)"},
     "case when (tick - tick % 10) / 10 % 12 = g then 0 else 1 end", "true"),
    ("kafka_consumer_consumer_fetch_manager_metrics_records_lag",
     {"client_id": "concat('sink-', g)", "topic": "concat('sqlserver.shop.dbo.t', g)", "partition": "'0'",
      "node": "'node-4'"},
     "tick % 100 * 250 * (g + 1)", "true"),
    ("debezium_metrics_number_of_erroneous_events",
     {"connector": "concat('c', g)", "context": "'streaming'", "node": "concat('node-', g % 4)"},
     "(tick - tick % (37 + g)) / (37 + g)", "true"),
    ("debezium_metrics_rows_scanned",
     {"connector": "concat('c', g)", "context": "'snapshot'", "node": "concat('node-', g % 4)"},
     "(tick - tick % 200) / 200 * 50 + least(tick % 200, 50)", "g < 4"),
    ("debezium_metrics_remaining_table_count",
     {"connector": "concat('c', g)", "context": "'snapshot'", "node": "concat('node-', g % 4)"},
     "case when tick % 400 < 300 then 3 else 0 end", "g < 4"),
    ("debezium_metrics_queue_remaining_capacity",
     {"connector": "concat('c', g)", "context": "'streaming'", "node": "concat('node-', g % 4)"}, "512 - v", "true"),
    ("debezium_metrics_queue_total_capacity",
     {"connector": "concat('c', g)", "context": "'streaming'", "node": "concat('node-', g % 4)"}, "512", "true"),
    ("node_cpu_seconds_total",
     {"mode": "'idle'", "cpu": "case when g < 4 then '0' else '1' end", "instance": "concat('n', g % 4)", "node": "concat('node-', g % 4)"},
     "(tick - tick % 140) / 140 * 840 + least(tick % 140, 60) * 12 + greatest(tick % 140 - 60, 0) * 1.5", "true"),
    ("node_memory_MemAvailable_bytes", {"instance": "concat('n', g)", "node": "concat('node-', g)"},
     "case when (tick - tick % 40) / 40 % 2 = 1 then 10 else 50 end", "g < 4"),
    ("node_memory_MemTotal_bytes", {"instance": "concat('n', g)", "node": "concat('node-', g)"}, "100", "g < 4"),
    ("node_filesystem_avail_bytes",
     {"mountpoint": "'/data/kafka'", "instance": "concat('n', g)", "node": "concat('node-', g)"},
     "case when (tick - tick % 25) / 25 % 3 = 2 then 100 else 400 end", "g < 3"),
    ("node_filesystem_size_bytes",
     {"mountpoint": "'/data/kafka'", "instance": "concat('n', g)", "node": "concat('node-', g)"}, "1000", "g < 3"),
    ("kafka_connect_connect_worker_metrics_connector_failed_task_count",
     {"instance": "concat('i', g)", "node": "'node-4'"}, "case when tick % 97 < 10 then 1 else 0 end", "g = 2"),
    ("kafka_connect_connector_metrics_connector_failed_task_count",
     {"connector": "concat('c', g)", "node": "'node-4'"}, "case when tick % 113 < 3 then 1 else 0 end", "g < 4"),
    ("kafka_connect_sink_task_metrics_sink_record_send_rate",
     {"connector": "concat('c', g)", "task": "'0'", "node": "'node-4'"},
     "case when tick % 160 < 60 then 0 else 5 end", "g < 2"),
    ("kafka_connect_sink_task_metrics_put_batch_avg_time_ms",
     {"connector": "concat('c', g)", "task": "'0'", "node": "'node-4'"}, "v * 15", "true"),
    ("kafka_server_replicamanager_underreplicatedpartitions",
     {"instance": "concat('i', g)", "node": "concat('node-', g)"},
     "case when (tick - tick % 12) / 12 % 7 = 0 then 1 else 0 end", "g < 3"),
    ("kafka_controller_kafkacontroller_activecontrollercount",
     {"instance": "concat('i', g)", "node": "concat('node-', g)"},
     "case when g = 0 and tick % 200 >= 8 then 1 else 0 end", "g < 3"),
    ("kafka_controller_kafkacontroller_offlinepartitionscount",
     {"instance": "concat('i', g)", "node": "concat('node-', g)"}, "case when tick % 333 < 6 then 1 else 0 end", "g = 1"),
    ("kafka_log_log_size", {"topic": "'dlq-sink-forward'", "partition": "'0'", "node": "'node-0'"},
     "case when tick % 300 < 40 then 11534336 else 1024 end", "g = 0"),
]
LABELS = sorted({name for _, labels, _, _ in SCRAPE for name in labels})


def scrape(spark: SparkSession, root: str, metrics: list[str] | None = None, df: DataFrame | None = None) -> DataFrame:
    """Samples ``ts, metric, labels, series, value``: a narrow scan of ``events`` (or its stream
    ``df``) for each metric, so a filter on ``metric`` leaves out the scans of all others."""
    ev = (read_table(spark, root, "events") if df is None else df).select(
        ((F.col("event_id") - F.col("event_id") % 8) / 8).cast("bigint").alias("tick"),
        (F.col("event_id") % 8).alias("g"), F.floor("value").cast("bigint").alias("v"),
    )
    at = F.timestamp_micros(F.col("tick") * 15_000_000 + ORIGIN_US).cast("timestamp_ntz").alias("ts")
    found = []
    for metric, labels, value, cond in SCRAPE:
        if metrics is not None and metric not in metrics:
            continue
        pairs = ", ".join(f"'{k}', {v}" for k, v in labels.items())
        series = ", ',', ".join(f"'{k}=', {labels[k]}" for k in sorted(labels))
        found.append(ev.filter(cond).select(
            at, F.lit(metric).alias("metric"), F.expr(f"map({pairs})").alias("labels"), F.expr(f"concat({series})").alias("series"),
            F.expr(f"cast({value} as double)").alias("value")))
    return reduce(DataFrame.union, found)


def scrape_sql(metrics: list[str]) -> str:
    """``sec`` (seconds from the first grid point), metric, one column per label, value."""
    base = (
        "(SELECT CAST((event_id - event_id % 8) / 8 AS BIGINT) AS tick, event_id % 8 AS g, "
        "CAST(floor(value) AS BIGINT) AS v FROM events)"
    )
    parts = []
    for metric, labels, value, cond in SCRAPE:
        if metric in metrics:
            cols = ", ".join(f"{labels.get(n, chr(39) * 2)} AS {n}" for n in LABELS)
            parts.append(
                f"SELECT tick * 15 AS sec, '{metric}' AS metric, {cols}, CAST({value} AS DOUBLE) AS value "
                f"FROM {base} WHERE {cond}"
            )
    return " UNION ALL ".join(parts)


def sec(ts: str = "ts") -> Column:
    """Whole seconds since the first grid point."""
    us = F.unix_micros(F.col(ts).cast("timestamp")) - ORIGIN_US
    return ((us - F.pmod(us, F.lit(1_000_000))) / 1_000_000).cast("bigint")


CTES = {
    "orders_log": _orders_log_sql(),
    "events_log": EVENTS_LOG,
    "mixed_log": _mixed_sql(),
    "document_log": DOCUMENT_LOG,
    "dirty_orders": DIRTY_ORDERS,
}


def sql(body: str, *ctes: str, **extra: str) -> str:
    """A query with the named derived logs in front; ``extra`` are further common tables."""
    named = {c: CTES[c] for c in ctes} | extra
    head = ", ".join(f"{n} AS ({q})" for n, q in named.items())
    return f"WITH {head} {body}" if head else body
