"""The alert rules over the derived samples, from flags to notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.clock import from_micros, seconds
from rowtide.operators import alerts as al
from rowtide.plans.logs import SCRAPE, scrape, scrape_sql, sec, sql
from rowtide.plans.metrics import HOUR
from rowtide.sources.tables import cut_lineage

STEP = 15


def flags(spark, root):
    return al.evaluate(scrape(spark, root), chunk_us=HOUR)


def held(spark, root):
    return al.hold_for(flags(spark, root), STEP, chunk_us=HOUR)


def heard(spark, root):
    """Firing intervals after inhibition, with both lag alerts under one name: the warning is hidden
    on nodes where the critical fires. The few intervals that fire are stored first."""
    one = F.when(F.col("alertname").startswith("CDCLag"), "CDCLag").otherwise(F.col("alertname"))
    fires = al.firing(cut_lineage(held(spark, root))).withColumn("alertname", one)
    return al.inhibit(fires, STEP, chunk_us=HOUR)


def alert_flags(spark, root):
    return flags(spark, root).groupBy("alertname", "severity", "for_s").agg(
        F.count("*").alias("evaluated"), F.count_if("active").alias("active"))


def hold_for(spark, root):
    return held(spark, root).select(
        "alertname", "severity", "node", sec("pending_at").alias("pending_sec"), sec("firing_at").alias("firing_sec"),
        sec("last_at").alias("last_sec"), "state")


def inhibit(spark, root):
    step = seconds(STEP)
    n = F.sum(((F.col("end_us") - F.col("start_us")) / step).cast("bigint") + 1)
    out = heard(spark, root).groupBy("alertname", "severity", "node").agg(
        n.alias("instants"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    a, b = from_micros(F.col("start_us")).alias("a"), from_micros(F.col("end_us")).alias("b")
    return out.select("alertname", "severity", "node", "instants", a, b).select(
        "alertname", "severity", "node", "instants", sec("a").alias("first_sec"), sec("b").alias("last_sec"))


def notifications(spark, root):
    out = al.notifications(cut_lineage(heard(spark, root)), STEP, chunk_us=HOUR)
    return out.select("alertname", "severity", "node", sec("at").alias("sec"), "kind")


QUERIES = {
    "alert_flags": alert_flags,
    "hold_for": hold_for,
    "inhibit": inhibit,
    "notifications": notifications,
}

_LABEL_TEXT = ", ".join(sorted({n for _, labels, _, _ in SCRAPE for n in labels}))
_RANGES = """
    SELECT *, sum(inc) OVER (w RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) / 300.0 AS r5,
           sum(inc) OVER (w RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) / 600.0 AS r10,
           sum(moved) OVER (w RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS c15,
           CASE WHEN count(*) OVER (w RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) > 1 THEN
             regr_slope(value, sec) OVER (w RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) END AS d10
    FROM (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN value < p THEN value ELSE value - p END AS inc,
                 CASE WHEN p IS NOT NULL AND p <> value THEN 1 ELSE 0 END AS moved
          FROM (SELECT *, lag(value) OVER (PARTITION BY metric, series ORDER BY sec) AS p FROM s))
    WINDOW w AS (PARTITION BY metric, series ORDER BY sec)"""


def _each(name, severity, for_s, metric, active, where="true", source="s"):
    return (
        f"SELECT '{name}' AS alertname, '{severity}' AS severity, {for_s} AS for_s, node, series, sec, "
        f"{active} AS active FROM {source} WHERE metric = '{metric}' AND {where}"
    )


def _total(name, severity, for_s, metric, active, where="true", source="s"):
    return (
        f"SELECT '{name}', '{severity}', {for_s}, '', '', sec, {active} FROM {source} WHERE metric = '{metric}' "
        f"AND {where} GROUP BY sec"
    )


def _used(name, severity, for_s, free, total, limit):
    return (
        f"SELECT '{name}', '{severity}', {for_s}, a.node, a.instance, a.sec, (1 - a.value / b.value) * 100 > {limit} "
        f"FROM s a JOIN s b ON a.sec = b.sec AND a.node = b.node AND a.instance = b.instance "
        f"WHERE a.metric = '{free}' AND b.metric = '{total}'"
    )


_MSG, _DLQ = "kafka_server_brokertopicmetrics_messagesinpersec", "topic LIKE 'dlq-%'"
_BEHIND = "debezium_metrics_milliseconds_behind_source"
_FLAGS = " UNION ALL ".join([
    _each("CDCLagExceedsSLA", "warning", 300, _BEHIND, "value > 1000"),
    _each("CDCLagCritical", "critical", 300, _BEHIND, "value > 300000"),
    _each("ConnectWorkerDown", "critical", 60, "up", "value = 0", "job = 'kafka-connect'"),
    _each("ConnectorTaskFailed", "critical", 60, "kafka_connect_connect_worker_metrics_connector_failed_task_count", "value > 0"),
    _each("ConnectorTaskCountMismatch", "critical", 60, "kafka_connect_connector_metrics_connector_failed_task_count", "value > 0"),
    _each("SinkRecordsPutRateZero", "warning", 600, "kafka_connect_sink_task_metrics_sink_record_send_rate", "value = 0"),
    _each("DLQRecordsReceived", "critical", 120, _MSG, "r5 > 0", _DLQ + " AND r5 IS NOT NULL", "r"),
    _each("DLQHighVolume", "critical", 300, _MSG, "r5 > 1", _DLQ + " AND r5 IS NOT NULL", "r"),
    _total("ZeroThroughput", "warning", 900, _MSG, "sum(r10) = 0",
           "topic NOT LIKE 'dlq-%' AND r10 IS NOT NULL", "r"),
    _each("ConsumerLagGrowing", "warning", 600, "kafka_consumer_consumer_fetch_manager_metrics_records_lag",
          "d10 > 100", "d10 IS NOT NULL", "r"),
    _each("DebeziumErrors", "warning", 300, "debezium_metrics_number_of_erroneous_events", "r5 > 0", "r5 IS NOT NULL", "r"),
    _each("SnapshotStalled", "warning", 900, "debezium_metrics_rows_scanned",
          "c15 = 0 AND (sec, series) IN (SELECT (sec, series) FROM s WHERE metric = 'debezium_metrics_remaining_table_count' "
          "AND value > 0)", "true", "r"),
    _each("KafkaBrokerDown", "critical", 60, "up", "value = 0", "job = 'kafka-brokers'"),
    _each("UnderReplicatedPartitions", "warning", 120, "kafka_server_replicamanager_underreplicatedpartitions", "value > 0"),
    _total("NoActiveController", "critical", 60, "kafka_controller_kafkacontroller_activecontrollercount", "sum(value) = 0"),
    _each("OfflinePartitions", "critical", 60, "kafka_controller_kafkacontroller_offlinepartitionscount", "value > 0"),
    _used("BrokerDiskHigh", "critical", 300, "node_filesystem_avail_bytes", "node_filesystem_size_bytes", 85),
    "SELECT 'BrokerCPUHigh', 'warning', 600, node, instance, sec, 100 - avg(r5) * 100 > 80 FROM r "
    "WHERE metric = 'node_cpu_seconds_total' AND r5 IS NOT NULL GROUP BY node, instance, sec",
    _used("HighMemoryUsage", "warning", 300, "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes", 85),
    _each("NodeDown", "critical", 120, "up", "value = 0", "job = 'node-exporter'"),
    _total("DLQMessagesProduced", "warning", 60, _MSG, "sum(r5) > 0", _DLQ + " AND r5 IS NOT NULL", "r"),
    _each("DLQBacklogGrowing", "critical", 300, "kafka_log_log_size", "value > 10485760"),
])
_HELD = """
    SELECT *, CASE WHEN start_sec + ceil(for_s / 15.0) * 15 <= end_sec THEN CAST(start_sec + ceil(for_s / 15.0) * 15 AS BIGINT) END
           AS fire_sec
    FROM (SELECT alertname, severity, for_s, node, series, min(sec) AS start_sec, max(sec) AS end_sec
          FROM (SELECT *, sum(CASE WHEN p IS NULL OR sec - p > 15 THEN 1 ELSE 0 END)
                       OVER (PARTITION BY alertname, severity, node, series ORDER BY sec) AS run
                FROM (SELECT *, lag(sec) OVER (PARTITION BY alertname, severity, node, series ORDER BY sec) AS p
                      FROM flags WHERE active))
          GROUP BY alertname, severity, for_s, node, series, run)"""
_INSTANTS = """
    SELECT alertname, severity, node, series, unnest(generate_series(fire_sec, end_sec, 15)) AS sec
    FROM held WHERE fire_sec IS NOT NULL"""
_HEARD = """
    SELECT * FROM (SELECT * REPLACE (CASE WHEN alertname LIKE 'CDCLag%' THEN 'CDCLag' ELSE alertname END AS alertname) FROM instants) i
    WHERE NOT (severity = 'warning' AND (alertname, node, sec) IN
      (SELECT (CASE WHEN alertname LIKE 'CDCLag%' THEN 'CDCLag' ELSE alertname END, node, sec) FROM instants
       WHERE severity = 'critical'))"""
_JOINS = """
    SELECT alertname, severity, node, series, sec AS joined
    FROM (SELECT *, lag(sec) OVER (PARTITION BY alertname, severity, node, series ORDER BY sec) AS p FROM heard)
    WHERE p IS NULL OR sec - p > 15"""
_EPISODES = """
    SELECT alertname, severity, node, min(sec) AS a, max(sec) AS b,
           min(sec) + CASE severity WHEN 'critical' THEN 10 ELSE 60 END AS f
    FROM (SELECT *, sum(CASE WHEN p IS NULL OR sec - p > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY alertname, severity, node ORDER BY sec) AS run
          FROM (SELECT *, lag(sec) OVER (PARTITION BY alertname, severity, node ORDER BY sec) AS p
                FROM (SELECT DISTINCT alertname, severity, node, sec FROM heard)))
    GROUP BY alertname, severity, node, run"""


def _chain(body, *parts):
    known = {"s": f"SELECT *, concat_ws('|', {_LABEL_TEXT}) AS series FROM ({scrape_sql([m for m, *_ in SCRAPE])})",
             "r": _RANGES, "flags": _FLAGS, "held": _HELD, "instants": _INSTANTS, "heard": _HEARD, "joins": _JOINS, "episodes": _EPISODES}
    return sql(body, **{k: v for k, v in known.items() if k in ("s", "r", "flags") or k in parts})


ORACLE = {
    "alert_flags": _chain(
        "SELECT alertname, severity, for_s, count(*) AS evaluated, count(*) FILTER (WHERE active) AS active FROM flags GROUP BY ALL"),
    "hold_for": _chain("""
        SELECT alertname, severity, node, start_sec AS pending_sec, fire_sec AS firing_sec, end_sec AS last_sec,
               CASE WHEN fire_sec IS NULL THEN 'pending' ELSE 'firing' END AS state FROM held""", "held"),
    "inhibit": _chain("""
        SELECT alertname, severity, node, count(*) AS instants, min(sec) AS first_sec, max(sec) AS last_sec
        FROM heard GROUP BY ALL""", "held", "instants", "heard"),
    "notifications": _chain("""
        SELECT alertname, severity, node, moment AS sec, CASE WHEN moment = f THEN 'first' ELSE 'repeat' END AS kind
        FROM (SELECT *, unnest(generate_series(f, b, CASE severity WHEN 'critical' THEN 3600 ELSE 14400 END)) AS moment
              FROM episodes WHERE f <= b)
        UNION ALL SELECT DISTINCT alertname, severity, node, moment, 'update' FROM (
          SELECT e.*, CAST(f + ceil((joined - f) / 300.0) * 300 AS BIGINT) AS moment FROM episodes e JOIN joins j
          USING (alertname, severity, node) WHERE e.f <= e.b AND joined > e.f AND joined <= e.b) WHERE moment <= b
        UNION ALL SELECT alertname, severity, node, CAST(f + (floor((b - f) / 300.0) + 1) * 300 AS BIGINT), 'resolved'
        FROM episodes WHERE f <= b
        """, "held", "instants", "heard", "joins", "episodes"),
}
