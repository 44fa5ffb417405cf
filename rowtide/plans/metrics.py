"""Telemetry of the pipeline: series, rates, percentiles, lags, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.labels import label, series_key
from rowtide.operators import alerts as al
from rowtide.operators import metric_names as mn
from rowtide.operators import sketches as sk
from rowtide.operators import telemetry as tm
from rowtide.plans.logs import ORIGIN_US, document_log, events_log, mixed_log, orders, scrape, scrape_sql, sec, sql
from rowtide.sources.tables import cut_lineage, read_table

HOUR = 3_600_000_000
MESSAGES = "kafka_server_brokertopicmetrics_messagesinpersec"
LAG = "debezium_metrics_milliseconds_behind_source"
RECORDS_LAG = "kafka_consumer_consumer_fetch_manager_metrics_records_lag"
MEMORY = ["node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"]
DISK = ["node_filesystem_avail_bytes", "node_filesystem_size_bytes"]
QUEUE = ["debezium_metrics_queue_remaining_capacity", "debezium_metrics_queue_total_capacity"]
ROWS, LEFT = "debezium_metrics_rows_scanned", "debezium_metrics_remaining_table_count"


def samples(spark, root, *metrics):
    return tm.with_series(scrape(spark, root, list(metrics)))


def tag(name):
    return label(F.col("labels"), name).alias(name)


def select_series(spark, root):
    got = tm.select_series(scrape(spark, root, [LAG]), LAG, {"context": "streaming"}, {"connector": "c[0-5]"}, {"node": "node-2"})
    return got.select(sec().alias("sec"), tag("connector"), "value")


def _rate(window_s):
    def run(spark, root):
        return tm.rate(samples(spark, root, MESSAGES), window_s, chunk_us=HOUR).select(
            sec().alias("sec"), tag("topic"), "rate")
    return run


def _avg(window_s):
    def run(spark, root):
        return tm.over_time(samples(spark, root, LAG), "avg", window_s, chunk_us=HOUR).select(
            sec().alias("sec"), tag("connector"), (F.col("avg_over_time") / 1000).alias("lag_s"))
    return run


def deriv_10m(spark, root):
    out = tm.deriv(samples(spark, root, RECORDS_LAG), 600, chunk_us=HOUR).filter(F.col("deriv").isNotNull())
    return out.select(sec().alias("sec"), tag("client_id"), F.round("deriv", 5).alias("slope"))


def changes_15m(spark, root):
    return tm.changes(samples(spark, root, ROWS), 900, chunk_us=HOUR).select(
        sec().alias("sec"), tag("connector"), "changes")


def sum_by_node(spark, root):
    out = tm.agg_series(samples(spark, root, RECORDS_LAG), "sum", ["topic"])
    return out.select(sec().alias("sec"), "topic", "value")


def avg_by_node(spark, root):
    out = tm.agg_series(samples(spark, root, LAG), "avg", ["node"])
    return out.select(sec().alias("sec"), "node", "value")


def or_zero(spark, root):
    """Targets down per instant; zero where all are up."""
    up = scrape(spark, root, ["up"])
    down = tm.agg_series(up.filter(F.col("value") == 0), "count", []).withColumn("value", F.col("value").cast("double"))
    return tm.or_zero(down, tm.grid(up, 15)).select(sec().alias("sec"), "value")


def memory_percent(spark, root):
    out = tm.used_percent(scrape(spark, root, MEMORY), *MEMORY, ["node"])
    return out.select(sec().alias("sec"), "node", "value")


def disk_percent(spark, root):
    out = tm.used_percent(scrape(spark, root, DISK), *DISK, ["instance", "node"], {"mountpoint": "/data/kafka"})
    return out.select(sec().alias("sec"), "node", "value")


def cpu_busy(spark, root):
    idle = tm.rate(samples(spark, root, "node_cpu_seconds_total"), 300, chunk_us=HOUR)
    return tm.busy_percent(idle, ["node"]).select(sec().alias("sec"), "node", F.round("value", 6).alias("value"))


def queue_use(spark, root):
    out = tm.queue_use(scrape(spark, root, QUEUE), *QUEUE, ["connector"])
    return out.select(sec().alias("sec"), "connector", "value")


def combine_series(spark, root):
    """Lag per rows scanned: two metrics combined on equal instant and connector."""
    s = scrape(spark, root, [LAG, ROWS])
    a = s.filter(F.col("metric") == LAG).select("ts", tag("connector"), "value")
    b = s.filter(F.col("metric") == ROWS).select("ts", tag("connector"), "value")
    out = tm.combine(a, b, ["ts", "connector"], F.col("a_value") / (F.col("b_value") + 1))
    return out.select(sec().alias("sec"), "connector", "value")


def both_conditions(spark, root):
    """Instants at which nothing was scanned for 15 minutes although tables remain."""
    still = tm.changes(samples(spark, root, ROWS), 900, chunk_us=HOUR).filter(F.col("changes") == 0)
    left = samples(spark, root, LEFT).filter(F.col("value") > 0)
    return tm.both(still, left, ["ts", "series"]).select(sec().alias("sec"), tag("connector"))


def resample(spark, root):
    out = tm.resample(samples(spark, root, LAG), 60)
    return out.select(sec().alias("sec"), "series", "value")


def last_value(spark, root):
    gaps = samples(spark, root, LAG).withColumn(
        "value", F.when(F.pmod(F.col("value"), F.lit(3.0)) == 0, None).when(
            F.pmod(F.col("value"), F.lit(3.0)) == 1, float("nan")).otherwise(F.col("value")))
    out = tm.last_value(gaps)
    return out.select("series", sec().alias("sec"), "value")


def label_values(spark, root):
    return tm.label_values(scrape(spark, root, [LAG]), LAG, "connector")


def target_labels(spark, root):
    """Scrape targets with their static labels, one per supplier number below eight."""
    s = F.col("s_suppkey")
    job = F.when(s < 3, "kafka-brokers").when(s < 5, "kafka-connect").otherwise("node-exporter")
    targets = read_table(spark, root, "supplier").select(
        job.alias("job"), F.concat(F.lit("i"), s).alias("instance"),
        F.create_map(F.lit("role"), F.lit("broker"), F.lit("node"), F.lit("static")).alias("labels"))
    out = tm.with_target_labels(scrape(spark, root, ["up"]), targets)
    return out.select(sec().alias("sec"), series_key(F.col("labels")).alias("labels"), "value")


def replication_lag(spark, root):
    return tm.lag_ms(events_log(spark, root)).select("offset", "lag_ms")


def idle_time(spark, root):
    log = events_log(spark, root)
    until = ORIGIN_US + 30 * 86400 * 1_000_000
    by_type = log.select("ts", F.col("after.event_type").alias("event_type"))
    out = tm.idle_ms(by_type, 3600, ["event_type"], until)
    return out.select(sec().alias("sec"), "event_type", F.round("idle_ms", 0).cast("bigint").alias("idle_ms"))


def _end_offsets(spark, root):
    return events_log(spark, root).groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def consumer_lag(spark, root):
    ends = _end_offsets(spark, root)
    behind = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(n).alias("behind")) for g, n in
                       (("connect-even", 0), ("connect-near", 100), ("connect-far", 400))])
    committed = ends.select("topic", "partition", "end_offset", F.inline(behind)).select(
        "group", "topic", "partition", (F.col("end_offset") - F.col("behind")).alias("committed"))
    return tm.consumer_lag(ends, committed, committed)


def dlq_depth(spark, root):
    catalog = mixed_log(spark, root).groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    expected = spark.createDataFrame([("dlq-sink-forward",), ("dlq-sink-reverse",)], "topic string")
    return tm.dlq_depth(catalog, expected)


def event_mix(spark, root):
    out = tm.event_mix(events_log(spark, root), "1 hour")
    return out.select(sec().alias("sec"), "creates", "updates", "deletes", "reads")


def throughput(spark, root):
    out = tm.throughput(events_log(spark, root), 3600, ["partition"], F.octet_length("after.event_type"))
    return out.select("partition", sec().alias("sec"), "records_per_s", "bytes_per_s", "mb_per_s")


def latency_percentiles(spark, root):
    out = tm.latency_summary(read_table(spark, root, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "max", "p50", "p75", "p95", "p99")])


def latency_rollup(spark, root):
    """Days merged from stored hours, with the exact share of rows at or below each quantile beside it."""
    ev = read_table(spark, root, "events")
    hours = cut_lineage(sk.hourly(ev, ["event_type"], "ts", "value", "user_id"))
    days = sk.latency_rollup(hours, ["event_type"])
    days = days.select("event_type", "day", "rows", "n", "least", "most", *[sk.quantile(q).alias(f"q{i}") for i, q in enumerate(_ROLLED)])
    near = ev.withColumn("day", F.date_trunc("day", "ts")).join(days, ["event_type", "day"]).groupBy("event_type", "day", "rows", "n", "least", "most").agg(
        *[F.count_if(F.col("value") < F.col(f"q{i}")).alias(f"a{i}") for i in range(len(_ROLLED))],
        *[F.count_if(F.col("value") <= F.col(f"q{i}")).alias(f"b{i}") for i in range(len(_ROLLED))])
    slack = 2 * sk.RANK_ERROR * F.col("n") + 1
    inside = F.lit(True)
    for i, q in enumerate(_ROLLED):
        inside = inside & (F.col(f"a{i}") - slack <= q * F.col("n")) & (q * F.col("n") <= F.col(f"b{i}") + slack)
    return near.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", "n", "least", "most", inside.alias("within"))


_ROLLED = [0.5, 0.95, 0.99]


def normalise_metrics(spark, root):
    i, u = F.col("event_id") % 12, (F.col("user_id") % 3).cast("string")
    full = F.concat(F.lit("debezium.sql_server<type=connector-metrics, server=srv"), u,
                    F.lit(", task=0, context=streaming, database=shop><>"))
    pg = "debezium.postgres<type=connector-metrics, context="
    beans = [
        F.concat(full, F.lit("MilliSecondsBehindSource: 12")),
        F.concat(full, F.lit("RowsScanned")),
        F.concat(full, F.lit("MaxQueueSizeInBytes: 5")),
        F.concat(F.lit("debezium.sql_server<type=connector-metrics, server=srv"), u,
                 F.lit(", task=1, context=schema-history><>ChangesApplied")),
        F.lit(pg + "streaming, server=aurora><>NumberOfErroneousEvents"),
        F.lit(pg + "snapshot, server=aurora><>SnapshotDurationInSeconds"),
        F.lit("kafka.connect<type=connect-worker-metrics><>task-count"),
        F.concat(F.lit("kafka.connect<type=sink-task-metrics, connector=sink"), u, F.lit(", task=2><>put-batch-avg-time-ms")),
        F.concat(F.lit("kafka.consumer<type=consumer-fetch-manager-metrics, client-id=cl, topic=t"), u,
                 F.lit(", partition=0><>records-lag")),
        F.lit("java.lang<type=GarbageCollector, name=G1 Young Generation><>CollectionCount"),
        F.lit("java.lang<type=Memory><HeapMemoryUsage>used"),
    ]
    bean = F.lit("unknown<type=x><>y")
    for n, b in reversed(list(enumerate(beans))):
        bean = F.when(i == n, b).otherwise(bean)
    lines = read_table(spark, root, "events").select("event_id", bean.alias("bean"))
    return _named(lines, mn.connect_rules())


def _named(lines, rules):
    out = mn.normalise_metrics(lines, rules)
    return out.select("event_id", "metric", "type", series_key(F.col("labels")).alias("labels"))


def _cycle(spark, root, beans):
    bean = F.lit("unknown<type=x><>y")
    for n, b in reversed(list(enumerate(beans))):
        bean = F.when(F.col("event_id") % (len(beans) + 1) == n, F.lit(b)).otherwise(bean)
    return read_table(spark, root, "events").select("event_id", bean.alias("bean"))


BROKER_BEANS = [
    ("kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=a.b.c><>Count",
     "kafka_server_brokertopicmetrics_messagesinpersec", "COUNTER", "topic=a.b.c"),
    ("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec><>OneMinuteRate",
     "kafka_server_brokertopicmetrics_bytesinpersec_rate", "GAUGE", ""),
    ("kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>99thPercentile",
     "kafka_network_requestmetrics_totaltimems", "GAUGE", "quantile=0.99,request=Produce"),
    ("kafka.log<type=Log, name=Size, topic=dlq-x, partition=3><>Value", "kafka_log_log_size", "GAUGE",
     "partition=3,topic=dlq-x"),
    ("java.lang<type=GarbageCollector, name=G1 Old Generation><CollectionTime>", "jvm_gc_collection_time_ms", "COUNTER",
     "gc=G1 Old Generation"),
]
REGISTRY_BEANS = [
    ("kafka.schema.registry<type=jetty-metrics><>connections-active", "kafka_schema_registry_jetty_connections_active",
     "GAUGE", ""),
    ("kafka.schema.registry<type=jersey-metrics><>subjects.versions.register.request-latency-99",
     "kafka_schema_registry_jersey_request_latency_99", "GAUGE", "endpoint=subjects.versions.register"),
    ("kafka.schema.registry<type=api-failure-count><>api-failure-count", "kafka_schema_registry_api_failure_count",
     "GAUGE", ""),
    ("kafka.producer<type=producer-metrics, client-id=p-1><>record-send-rate",
     "kafka_schema_registry_producer_record_send_rate", "GAUGE", "client_id=p-1"),
]


def normalise_broker(spark, root):
    return _named(_cycle(spark, root, [b for b, *_ in BROKER_BEANS]), mn.broker_rules())


def normalise_registry(spark, root):
    return _named(_cycle(spark, root, [b for b, *_ in REGISTRY_BEANS]), mn.registry_rules())


def target_health(spark, root):
    s = F.col("s_suppkey")
    targets = read_table(spark, root, "supplier").select(
        F.concat(F.lit("job"), s % 5).alias("job"), F.col("s_name").alias("instance"),
        F.when(s % 10 == 3, "down").otherwise("up").alias("health"))
    return tm.target_health(targets)


def connector_status(spark, root):
    c = F.col("c_custkey")

    def task(n, state):
        return F.struct(F.lit(n).alias("id"), state.alias("state"))

    state = F.when(c % 11 == 0, "FAILED").when(c % 7 == 0, "PAUSED").when(c % 13 != 0, "RUNNING")
    second = F.when(c % 5 == 0, "FAILED").otherwise("RUNNING")
    status = read_table(spark, root, "customer").select(
        F.concat(F.lit("cluster"), c % 2).alias("cluster"), F.col("c_name").alias("connector"), state.alias("state"),
        F.array(task(0, F.lit("RUNNING")), task(1, second)).alias("tasks"))
    return tm.connector_status(status)


def stage_latency(spark, root):
    stages = orders(spark, root).select(
        F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("stage"),
        (F.col("o_custkey") % 100).alias("ms"))
    return tm.stage_latency(stages)


def top_topics(spark, root):
    return tm.top_topics(document_log(spark, root), 5, F.octet_length("value"))


def service_rollup(spark, root):
    c = F.col("c_custkey")
    body = F.to_json(F.struct(
        F.when(c % 2 == 0, F.col("c_name")).alias("Name"), F.when(c % 2 == 1, F.col("c_name")).alias("Names"),
        F.when(c % 4 == 0, "running").when(c % 4 == 1, "exited").alias("State"),
        F.when(c % 4 == 2, "Up 18 minutes").when(c % 4 == 3, "Exited (1)").alias("Status")))
    lines = read_table(spark, root, "customer").select(
        F.concat(F.lit("node"), F.col("c_nationkey")).alias("node"),
        F.when(F.col("c_nationkey") == 7, "connection refused").otherwise(body).alias("line"))
    return tm.service_rollup(lines)


def classify(spark, root):
    bands = {"lag_s": al.COLOURS["lag_s"], "batch_ms": al.COLOURS["batch_ms"]}
    s = scrape(spark, root, [LAG, "kafka_connect_sink_task_metrics_put_batch_avg_time_ms"])
    colour = F.when(F.col("metric") == LAG, al.classify(F.col("value") / 1000, bands["lag_s"])).otherwise(
        al.classify(F.col("value"), bands["batch_ms"]))
    return s.select(sec().alias("sec"), "metric", tag("connector"), "value", colour.alias("colour"))


QUERIES = {
    "select_series": select_series,
    "rate_5m": _rate(300),
    "rate_10m": _rate(600),
    "avg_over_time_15m": _avg(900),
    "avg_over_time_1h": _avg(3600),
    "deriv_10m": deriv_10m,
    "changes_15m": changes_15m,
    "sum_by_topic": sum_by_node,
    "avg_by_node": avg_by_node,
    "or_zero": or_zero,
    "memory_percent": memory_percent,
    "disk_percent": disk_percent,
    "cpu_busy": cpu_busy,
    "queue_use": queue_use,
    "combine_series": combine_series,
    "both_conditions": both_conditions,
    "resample": resample,
    "last_value": last_value,
    "label_values": label_values,
    "target_labels": target_labels,
    "replication_lag": replication_lag,
    "idle_time": idle_time,
    "consumer_lag": consumer_lag,
    "dlq_depth": dlq_depth,
    "event_mix": event_mix,
    "throughput": throughput,
    "latency_percentiles": latency_percentiles,
    "latency_rollup": latency_rollup,
    "normalise_metrics": normalise_metrics,
    "normalise_broker_metrics": normalise_broker,
    "normalise_registry_metrics": normalise_registry,
    "target_health": target_health,
    "connector_status": connector_status,
    "stage_latency": stage_latency,
    "top_topics": top_topics,
    "service_rollup": service_rollup,
    "classify_lag": classify,
}


def _inc(series):
    return (
        f"SELECT *, CASE WHEN p IS NULL THEN NULL WHEN value < p THEN value ELSE value - p END AS inc, "
        f"CASE WHEN p IS NOT NULL AND p <> value THEN 1 ELSE 0 END AS moved FROM "
        f"(SELECT *, lag(value) OVER (PARTITION BY {series} ORDER BY sec) AS p FROM s)"
    )


def _over(series, window_s):
    return f"OVER (PARTITION BY {series} ORDER BY sec RANGE BETWEEN {window_s - 1} PRECEDING AND CURRENT ROW)"


def _rate_sql(window_s):
    return sql(
        f"SELECT sec, topic, rate FROM (SELECT sec, topic, sum(inc) {_over('topic', window_s)} / {window_s}.0 AS rate "
        "FROM i) WHERE rate IS NOT NULL", s=scrape_sql([MESSAGES]), i=_inc("topic"))


def _avg_sql(window_s):
    return sql(f"SELECT sec, connector, avg(value) {_over('connector', window_s)} / 1000 AS lag_s FROM s",
               s=scrape_sql([LAG]))


def _percent(free, total, on, more=""):
    return sql(
        f"SELECT a.sec, a.{on}, (1 - a.value / b.value) * 100 AS value FROM s a JOIN s b ON a.sec = b.sec AND a.{on} = b.{on} "
        f"AND a.metric = '{free}' AND b.metric = '{total}'{more}", s=scrape_sql([free, total]))


def _series(*names):
    return " || ',' || ".join(f"'{n}=' || {n}" for n in names)


def _named_sql(beans):
    arms = [f"WHEN {n} THEN {{{n}}}" for n in range(len(beans))]
    cols = []
    for pos, name in ((1, "metric"), (2, "type"), (3, "labels")):
        text = " ".join(a.format(*[f"'{b[pos]}'" for b in beans]) for a in arms)
        cols.append(f"CASE event_id % {len(beans) + 1} {text} END AS {name}")
    return f"SELECT event_id, {', '.join(cols)} FROM events WHERE event_id % {len(beans) + 1} <> {len(beans)}"


ORACLE = {
    "select_series": sql(
        "SELECT sec, connector, value FROM s WHERE context = 'streaming' AND connector IN "
        "('c0','c1','c2','c3','c4','c5') AND node <> 'node-2'", s=scrape_sql([LAG])),
    "rate_5m": _rate_sql(300),
    "rate_10m": _rate_sql(600),
    "avg_over_time_15m": _avg_sql(900),
    "avg_over_time_1h": _avg_sql(3600),
    "deriv_10m": sql(
        f"SELECT sec, client_id, round(d, 5) AS slope FROM (SELECT sec, client_id, CASE WHEN count(*) {_over('client_id', 600)} > 1 "
        f"THEN regr_slope(value, sec) {_over('client_id', 600)} END AS d FROM s) WHERE d IS NOT NULL",
        s=scrape_sql([RECORDS_LAG])),
    "changes_15m": sql(
        f"SELECT sec, connector, CAST(sum(moved) {_over('connector', 900)} AS BIGINT) AS changes FROM i",
        s=scrape_sql([ROWS]), i=_inc("connector")),
    "sum_by_topic": sql("SELECT sec, topic, sum(value) AS value FROM s GROUP BY ALL", s=scrape_sql([RECORDS_LAG])),
    "avg_by_node": sql("SELECT sec, node, avg(value) AS value FROM s GROUP BY ALL", s=scrape_sql([LAG])),
    "or_zero": sql("SELECT sec, CAST(count(*) FILTER (WHERE value = 0) AS DOUBLE) AS value FROM s GROUP BY sec",
                   s=scrape_sql(["up"])),
    "memory_percent": _percent("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes", "node"),
    "disk_percent": _percent("node_filesystem_avail_bytes", "node_filesystem_size_bytes", "node"),
    "cpu_busy": sql(
        f"SELECT sec, node, round(100 - avg(rate) * 100, 6) AS value FROM (SELECT sec, node, sum(inc) {_over('node, cpu', 300)} / 300.0 "
        "AS rate FROM i) WHERE rate IS NOT NULL GROUP BY ALL",
        s=scrape_sql(["node_cpu_seconds_total"]), i=_inc("node, cpu")),
    "queue_use": _percent("debezium_metrics_queue_remaining_capacity", "debezium_metrics_queue_total_capacity", "connector"),
    "combine_series": sql(
        f"SELECT a.sec, a.connector, a.value / (b.value + 1) AS value FROM s a JOIN s b ON a.sec = b.sec AND "
        f"a.connector = b.connector AND a.metric = '{LAG}' AND b.metric = '{ROWS}'", s=scrape_sql([LAG, ROWS])),
    "both_conditions": sql(
        f"SELECT sec, connector FROM (SELECT sec, connector, sum(moved) {_over('connector', 900)} AS n FROM i) WHERE n = 0 "
        "AND (sec, connector) IN (SELECT (sec, connector) FROM l WHERE value > 0)",
        s=scrape_sql([ROWS]), i=_inc("connector"), l=scrape_sql([LEFT])),
    "resample": sql(
        f"SELECT sec - sec % 60 AS sec, {_series('connector', 'context', 'node')} AS series, arg_max(value, sec) AS value "
        "FROM s GROUP BY ALL", s=scrape_sql([LAG])),
    "last_value": sql(
        f"SELECT {_series('connector', 'context', 'node')} AS series, max(sec) AS sec, arg_max(value, sec) AS value "
        "FROM s WHERE value % 3 = 2 GROUP BY ALL", s=scrape_sql([LAG])),
    "label_values": sql("SELECT DISTINCT connector AS value FROM s", s=scrape_sql([LAG])),
    "target_labels": sql(
        f"SELECT sec, {_series('instance', 'job', 'node')} || CASE WHEN instance IN (SELECT 'i' || s_suppkey FROM supplier) "
        "THEN ',role=broker' ELSE '' END AS labels, value FROM s", s=scrape_sql(["up"])),
    "replication_lag": "SELECT event_id AS offset, CAST(event_id % 7 * 1000 AS DOUBLE) AS lag_ms FROM events",
    "idle_time": sql("""
        SELECT g AS sec, event_type, CAST(round((g * 1000000 - last) / 1000.0, 0) AS BIGINT) AS idle_ms FROM (
          SELECT p.g, p.event_type, max(e.us) AS last FROM
            (SELECT event_type, unnest(generate_series(first, 2592000, 3600)) AS g FROM (
               SELECT event_type, CAST(ceil(min(us) / 3600000000.0) * 3600 AS BIGINT) AS first FROM e GROUP BY 1)) p
            ASOF JOIN e ON p.event_type = e.event_type AND p.g * 1000000 >= e.us GROUP BY ALL)
        UNION ALL SELECT CAST(ceil(max(us) / 3600000000.0) * 3600 AS BIGINT), event_type,
            CAST(round((CAST(ceil(max(us) / 3600000000.0) * 3600 AS BIGINT) * 1000000 - max(us)) / 1000.0, 0) AS BIGINT)
        FROM e GROUP BY event_type HAVING ceil(max(us) / 3600000000.0) * 3600 > 2592000""",
        "events_log", e=f"SELECT event_type, epoch_us(ts) - {ORIGIN_US} AS us FROM events_log"),
    "consumer_lag": sql("""
        SELECT "group", n * behind AS lag, CASE WHEN n * behind = 0 THEN 'PASS' WHEN n * behind < 1000 THEN 'WARN' ELSE 'FAIL' END
               AS status FROM (SELECT count(DISTINCT part) AS n FROM events_log),
               (VALUES ('connect-even', 0), ('connect-near', 100), ('connect-far', 400)) v("group", behind)""", "events_log"),
    "dlq_depth": sql("""
        SELECT 'dlq-sink-forward' AS topic, CAST(sum(e) AS BIGINT) AS records, 'FAIL' AS status FROM (
          SELECT max(offs) + 1 AS e FROM mixed_log WHERE topic = 'dlq-sink-forward' GROUP BY part)
        UNION ALL SELECT 'dlq-sink-reverse', NULL, 'INFO'""", "mixed_log"),
    "event_mix": sql(f"""
        SELECT CAST((epoch_us(date_trunc('hour', ts)) - {ORIGIN_US}) // 1000000 AS BIGINT) AS sec, count(*) FILTER (WHERE op = 'c') AS creates,
               count(*) FILTER (WHERE op = 'u') AS updates, count(*) FILTER (WHERE op = 'd') AS deletes,
               CAST(0 AS BIGINT) AS reads FROM events_log GROUP BY 1""", "events_log"),
    "throughput": sql(f"""
        SELECT CAST(part AS INTEGER) AS partition, CAST((epoch_us(date_trunc('hour', ts)) - {ORIGIN_US}) // 1000000 AS BIGINT) AS sec,
               count(*) / 3600.0 AS records_per_s, sum(strlen(event_type)) / CAST(3600.0 AS DOUBLE) AS bytes_per_s,
               sum(strlen(event_type)) / CAST(3600.0 AS DOUBLE) / CAST(1048576.0 AS DOUBLE) AS mb_per_s
        FROM events_log GROUP BY 1, 2""", "events_log"),
    "latency_rollup": """
        SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS "rows", count(value) AS n, min(value) AS least,
               max(value) AS most, true AS within FROM events GROUP BY 1, 2""",
    "latency_percentiles": """
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max,
               round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
               round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
        FROM events GROUP BY event_type""",
    "normalise_metrics": """
        SELECT event_id, CASE i WHEN 0 THEN 'debezium_metrics_milliseconds_behind_source' WHEN 1 THEN 'debezium_metrics_rows_scanned'
                 WHEN 2 THEN 'debezium_metrics_maxqueuesizeinbytes' WHEN 3 THEN 'debezium_metrics_changesapplied'
                 WHEN 4 THEN 'debezium_metrics_number_of_erroneous_events' WHEN 5 THEN 'debezium_metrics_snapshotdurationinseconds'
                 WHEN 6 THEN 'kafka_connect_connect_worker_metrics_task_count'
                 WHEN 7 THEN 'kafka_connect_sink_task_metrics_put_batch_avg_time_ms'
                 WHEN 8 THEN 'kafka_consumer_consumer_fetch_manager_metrics_records_lag' WHEN 9 THEN 'jvm_gc_collection_count'
                 WHEN 10 THEN 'jvm_memory_heap_used' END AS metric,
               CASE WHEN i IN (1, 4, 9) THEN 'COUNTER' ELSE 'GAUGE' END AS type,
               CASE WHEN i < 3 THEN 'connector=srv' || u || ',context=streaming,database=shop,plugin=sqlserver,task=0'
                 WHEN i = 3 THEN 'connector=srv' || u || ',context=schema-history,plugin=sqlserver,task=1'
                 WHEN i = 4 THEN 'connector=aurora,context=streaming,plugin=postgres'
                 WHEN i = 5 THEN 'connector=aurora,context=snapshot,plugin=postgres'
                 WHEN i = 7 THEN 'connector=sink' || u || ',task=2' WHEN i = 8 THEN 'client_id=cl,partition=0,topic=t' || u
                 WHEN i = 9 THEN 'gc=G1 Young Generation' ELSE '' END AS labels
        FROM (SELECT event_id, event_id % 12 AS i, user_id % 3 AS u FROM events) WHERE i < 11""",
    "normalise_broker_metrics": _named_sql(BROKER_BEANS),
    "normalise_registry_metrics": _named_sql(REGISTRY_BEANS),
    "target_health": """
        SELECT job, up, total, CASE WHEN up = total THEN 'PASS' ELSE 'WARN' END AS status FROM (
          SELECT 'job' || s_suppkey % 5 AS job, count(*) FILTER (WHERE s_suppkey % 10 <> 3) AS up, count(*) AS total
          FROM supplier GROUP BY 1)""",
    "connector_status": """
        SELECT 'cluster' || c_custkey % 2 AS cluster, c_name AS connector, state,
               CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END AS running_tasks, 2 AS tasks,
               CASE WHEN state = 'RUNNING' AND c_custkey % 5 <> 0 THEN 'PASS' WHEN state IN ('RUNNING', 'PAUSED') THEN 'WARN'
                    ELSE 'FAIL' END AS status
        FROM (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'FAILED' WHEN c_custkey % 7 = 0 THEN 'PAUSED'
                        WHEN c_custkey % 13 <> 0 THEN 'RUNNING' ELSE 'UNKNOWN' END AS state FROM customer)""",
    "stage_latency": """
        SELECT o_orderpriority AS path, o_orderstatus AS stage, CAST(sum(o_custkey % 100) AS BIGINT) AS ms FROM orders GROUP BY 1, 2
        UNION ALL SELECT o_orderpriority, 'total', CAST(sum(o_custkey % 100) AS BIGINT) FROM orders GROUP BY 1""",
    "top_topics": sql(
        "SELECT topic, CAST(sum(size) AS BIGINT) AS bytes FROM document_log GROUP BY topic ORDER BY bytes DESC, topic LIMIT 5",
        "document_log"),
    "service_rollup": """
        SELECT node, running, stopped, CASE WHEN running + stopped = 0 THEN 'unreachable' WHEN stopped > 0 THEN 'degraded'
               ELSE 'up' END AS status
        FROM (SELECT 'node' || c_nationkey AS node, count(*) FILTER (WHERE c_nationkey <> 7 AND c_custkey % 2 = 0) AS running,
                     count(*) FILTER (WHERE c_nationkey <> 7 AND c_custkey % 2 = 1) AS stopped FROM customer GROUP BY 1)""",
    "classify_lag": sql(f"""
        SELECT sec, metric, connector, value, CASE WHEN metric = '{LAG}' THEN CASE WHEN value < 1000 THEN 'green'
                 WHEN value < 10000 THEN 'yellow' WHEN value < 60000 THEN 'orange' ELSE 'red' END
               WHEN value < 2000 THEN 'green' WHEN value < 5000 THEN 'yellow' ELSE 'red' END AS colour FROM s""",
        s=scrape_sql([LAG, "kafka_connect_sink_task_metrics_put_batch_avg_time_ms"])),
}
