"""Alert rules over samples, holding, inhibition, notification.

``evaluate`` turns samples into condition flags, one row per rule, series and instant;
``hold_for`` turns flags into pending and firing intervals; inhibition and grouping work on those
intervals, so a long alert costs no more than the chunks of time it lasts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions.clock import from_micros, micros, seconds
from rowtide.functions.labels import label
from rowtide.functions.names import whole
from rowtide.operators import telemetry as tm
from rowtide.operators.windows import DAY, asof_join, cut_out, merge_intervals, merge_runs, spread
from rowtide.sources.changes import union_all
from rowtide.sources.tables import stored


@dataclass(frozen=True)
class AlertRule:
    name: str
    kind: str
    metric: str
    op: str
    threshold: float
    for_s: int
    severity: str
    eq: dict[str, str] = field(default_factory=dict)
    regex: dict[str, str] = field(default_factory=dict)
    not_regex: dict[str, str] = field(default_factory=dict)
    window_s: int = 0
    other: str = ""


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_STREAMING, _SNAPSHOT = {"context": "streaming"}, {"context": "snapshot"}
_MESSAGES = "kafka_server_brokertopicmetrics_messagesinpersec"
_DLQ = {"topic": "dlq-.*"}

# The alert rules (name, expression parts, hold time, severity).
ALERT_RULES = [
    AlertRule("CDCLagExceedsSLA", "value", "debezium_metrics_milliseconds_behind_source", ">", 1000, 300, "warning",
              eq=_STREAMING),
    AlertRule("CDCLagCritical", "value", "debezium_metrics_milliseconds_behind_source", ">", 300000, 300, "critical",
              eq=_STREAMING),
    AlertRule("ConnectWorkerDown", "value", "up", "==", 0, 60, "critical", eq={"job": "kafka-connect"}),
    AlertRule("ConnectorTaskFailed", "value", "kafka_connect_connect_worker_metrics_connector_failed_task_count",
              ">", 0, 60, "critical"),
    AlertRule("ConnectorTaskCountMismatch", "value", "kafka_connect_connector_metrics_connector_failed_task_count",
              ">", 0, 60, "critical"),
    AlertRule("SinkRecordsPutRateZero", "value", "kafka_connect_sink_task_metrics_sink_record_send_rate",
              "==", 0, 600, "warning"),
    AlertRule("DLQRecordsReceived", "rate", _MESSAGES, ">", 0, 120, "critical", regex=_DLQ, window_s=300),
    AlertRule("DLQHighVolume", "rate", _MESSAGES, ">", 1, 300, "critical", regex=_DLQ, window_s=300),
    AlertRule("ZeroThroughput", "sum_rate", _MESSAGES, "==", 0, 900, "warning",
              not_regex={"topic": "__.*|_schemas|connect-.*|dlq-.*"}, window_s=600),
    AlertRule("ConsumerLagGrowing", "deriv", "kafka_consumer_consumer_fetch_manager_metrics_records_lag",
              ">", 100, 600, "warning", window_s=600),
    AlertRule("DebeziumErrors", "rate", "debezium_metrics_number_of_erroneous_events", ">", 0, 300, "warning",
              eq=_STREAMING, window_s=300),
    AlertRule("SnapshotStalled", "stalled", "debezium_metrics_rows_scanned", "==", 0, 900, "warning", eq=_SNAPSHOT,
              window_s=900, other="debezium_metrics_remaining_table_count"),
    AlertRule("KafkaBrokerDown", "value", "up", "==", 0, 60, "critical", eq={"job": "kafka-brokers"}),
    AlertRule("UnderReplicatedPartitions", "value", "kafka_server_replicamanager_underreplicatedpartitions",
              ">", 0, 120, "warning"),
    AlertRule("NoActiveController", "sum", "kafka_controller_kafkacontroller_activecontrollercount",
              "==", 0, 60, "critical"),
    AlertRule("OfflinePartitions", "value", "kafka_controller_kafkacontroller_offlinepartitionscount",
              ">", 0, 60, "critical"),
    AlertRule("BrokerDiskHigh", "used", "node_filesystem_avail_bytes", ">", 85, 300, "critical",
              eq={"mountpoint": "/data/kafka"}, other="node_filesystem_size_bytes"),
    AlertRule("BrokerCPUHigh", "busy", "node_cpu_seconds_total", ">", 80, 600, "warning", eq={"mode": "idle"},
              window_s=300),
    AlertRule("HighMemoryUsage", "used", "node_memory_MemAvailable_bytes", ">", 85, 300, "warning",
              other="node_memory_MemTotal_bytes"),
    AlertRule("NodeDown", "value", "up", "==", 0, 120, "critical", eq={"job": "node-exporter"}),
    AlertRule("DLQMessagesProduced", "sum_rate", _MESSAGES, ">", 0, 60, "warning", regex=_DLQ, window_s=300),
    AlertRule("DLQBacklogGrowing", "value", "kafka_log_log_size", ">", 10485760, 300, "critical", regex=_DLQ),
]

# Dashboard thresholds as (upper bound exclusive, colour); the last has no bound.
COLOURS = {
    "lag_s": [(1, "green"), (10, "yellow"), (60, "orange"), (None, "red")],
    "lag_avg_s": [(1, "green"), (3, "yellow"), (5, "orange"), (None, "red")],
    "disk_percent": [(70, "green"), (85, "yellow"), (None, "red")],
    "cpu_percent": [(80, "green"), (95, "yellow"), (None, "red")],
    "batch_ms": [(2000, "green"), (5000, "yellow"), (None, "red")],
}

# Seconds until the first notification, between updates of a group, and until a
# notification is sent again, by severity.
GROUP_INTERVAL_S = 300
GROUP_WAIT_S = {"critical": 10, "warning": 60}
REPEAT_S = {"critical": 3600, "warning": 14400}
DEFAULT_WAIT_S, DEFAULT_REPEAT_S = 30, 14400

FLAG = ["alertname", "severity", "node", "series", "for_s"]


def classify(value: Column, bounds: list[tuple[float | None, str]]) -> Column:
    """Name of the first band whose bound the value is below."""
    out = None
    for bound, name in bounds[:-1]:
        out = F.when(value < bound, name) if out is None else out.when(value < bound, name)
    return F.when(value.isNotNull(), out.otherwise(bounds[-1][1]))


_RANGE_FN = {"rate": "rate", "sum_rate": "rate", "busy": "rate", "deriv": "deriv", "stalled": "changes"}
_KEYS = ["alertname", "severity", "for_s", "ts", "node", "series"]
_MATCH = [("name", pa.string()), ("wanted", pa.string())]
_USES = pa.schema([
    ("_rule", pa.int32()), ("metric", pa.string()), ("_of", pa.string()), ("_per", pa.string()), ("_main", pa.bool_()),
    ("_positive", pa.bool_()), *[(n, pa.list_(pa.struct(_MATCH))) for n in ("_eq", "_regex", "_not_regex")],
])
_FACTS = pa.schema([
    ("_rule", pa.int32()), ("alertname", pa.string()), ("severity", pa.string()), ("for_s", pa.int32()), ("_kind", pa.string()),
    ("_op", pa.string()), ("_threshold", pa.float64()),
])


def _uses(rules: list[AlertRule]) -> list[dict]:
    """The metrics that each rule reads: which column, by what it is grouped, on which side of the
    rule's formula, and the conditions on labels."""
    out = []
    for i, r in enumerate(rules):
        per = {"sum": "", "sum_rate": "", "used": "instance", "busy": "instance"}.get(r.kind, "series")
        of = f"_{_RANGE_FN[r.kind]}_{r.window_s}" if r.kind in _RANGE_FN else "value"
        match = {"_eq": r.eq, "_regex": {k: whole(p) for k, p in r.regex.items()},
                 "_not_regex": {k: whole(p) for k, p in r.not_regex.items()}}
        use = {"_rule": i, "_per": per, **{n: [{"name": k, "wanted": v} for k, v in m.items()] for n, m in match.items()}}
        out.append({**use, "metric": r.metric, "_of": of, "_main": True, "_positive": False})
        if r.other:
            out.append({**use, "metric": r.other, "_of": "value", "_main": False, "_positive": r.kind == "stalled"})
    return out


def _readers(base: DataFrame, uses: list[dict]) -> DataFrame:
    """What rules read of each series: ``_sid, metric, series`` joined with ``uses``, where the label
    conditions hold, and ``_gid``, a number for ``_rule, node, member``, what a rule's value is told of.

    Conditions are met once for each series, not for each sample, and what is shuffled or summed later is
    told by numbers instead of labels. Both tables have a row for each series and use, and are stored.
    """
    read = base.filter(F.col("metric").isin(sorted({u["metric"] for u in uses})))
    series = read.select("metric", "series", F.map_entries("labels").alias("pairs")).distinct()  # by hash, which an aggregate of labels is not
    series = series.groupBy("metric", "series").agg(F.map_from_entries(F.any_value("pairs")).alias("labels"))
    series = stored(series.withColumn("_sid", F.monotonically_increasing_id()), "series")
    table = base.sparkSession.createDataFrame(pa.Table.from_pylist(uses, _USES))
    has = "coalesce(try_element_at(labels, m.name), '')"
    names = {"node": label(F.col("labels"), "node"), "instance": label(F.col("labels"), "instance")}
    per = "CASE _per WHEN 'series' THEN series WHEN 'instance' THEN instance ELSE '' END"
    met = (
        series.withColumns(names).join(table, "metric")
        .filter(f"forall(_eq, m -> {has} = m.wanted)")
        .filter(f"forall(_regex, m -> {has} rlike m.wanted) AND forall(_not_regex, m -> NOT {has} rlike m.wanted)")
        .selectExpr("_sid", "metric", "series", "_rule", "IF(_per = '', '', node) AS node", f"{per} AS member", "_of", "_main", "_positive")
    )
    told = stored(met.select("_rule", "node", "member").distinct().withColumn("_gid", F.monotonically_increasing_id()), "told")
    same = F.expr("m._rule = t._rule AND m.node = t.node AND m.member <=> t.member")
    return stored(met.alias("m").join(told.alias("t"), same).select("m.*", "t._gid"), "readers")


def _by_series(rows: DataFrame, readers: DataFrame) -> DataFrame:
    """Samples joined with what tells of their series."""
    right = readers.withColumnsRenamed({"metric": "_metric", "series": "_series"})
    return rows.join(right, (F.col("metric") == F.col("_metric")) & F.col("series").eqNullSafe(F.col("_series")))


# the rule's value from the sums of a group, by kind
_GROUPED = {
    "sum": "_sum", "sum_rate": "_sum", "rate": "_sum", "deriv": "_sum",
    "busy": "100 - _avg * 100",
    "used": "(1 - _max / _other) * 100",
    "stalled": "IF(_other IS NOT NULL, _max, NULL)",
}
_OPS = {">": ">", ">=": ">=", "<": "<", "<=": "<=", "==": "=", "!=": "<>"}


def _case(column: str, arms: dict[str, str]) -> Column:
    return F.expr(f"CASE {column} {' '.join(f'WHEN {text(k)} THEN {v}' for k, v in arms.items())} END")


def evaluate(samples: DataFrame, rules: list[AlertRule] | None = None, chunk_us: int = DAY) -> DataFrame:
    """Flags ``alertname, severity, for_s, ts, node, series, value, active`` of all rules.

    The rules are a table that the series are joined with by metric, so a sample meets only the
    rules that read it, and neither the passes over the samples nor the size of an expression
    depends on the number of rules. Threshold rules are one pass without a shuffle. Range functions
    are laid out by number of series and chunk of time, once per function, and what the samples add to
    a rule is summed per rule, instant and series, which also replaces the joins between two metrics.
    Labels and names come back after that. Rules that aggregate over series have the empty series and node.
    """
    rules = ALERT_RULES if rules is None else rules
    base = tm.with_series(samples)
    uses = _uses(rules)
    readers = _readers(base, uses)

    def of(chosen: list[dict]) -> DataFrame:
        return base.filter(F.col("metric").isin(sorted({u["metric"] for u in chosen}))).select("metric", "series", "ts", "value")

    def where(chosen: list[dict]) -> DataFrame:
        return readers.where(F.struct("_rule", "metric", "_of").isin([F.struct(*map(F.lit, (u["_rule"], u["metric"], u["_of"]))) for u in chosen]))

    def values(rows: DataFrame, columns: list[str]) -> DataFrame:
        v = F.expr(f"CASE _of {' '.join(f'WHEN {text(c)} THEN {c}' for c in columns)} END")
        return rows.withColumn("_v", v).filter("NOT _positive OR _v > 0").select("_gid", "ts", "_v", "_main")

    direct = [u for u in uses if rules[u["_rule"]].kind == "value"]
    plain = [u for u in uses if u["_of"] == "value" and u not in direct]
    out, adds = [], []
    if direct:
        out.append(_by_series(of(direct), where(direct)).select("_rule", "ts", "node", F.col("member").alias("series"), "value"))
    if plain:
        adds.append(values(_by_series(of(plain), where(plain)), ["value"]))
    ranged = [u for u in uses if u["_of"] != "value"]
    for fn in sorted({_RANGE_FN[rules[u["_rule"]].kind] for u in ranged}):
        # one layout per function: a frame costs its length for every row, so rows of metrics that
        # do not need it stay out
        mine = [u for u in ranged if _RANGE_FN[rules[u["_rule"]].kind] == fn]
        specs = {u["_of"]: (fn, rules[u["_rule"]].window_s) for u in mine}
        wanted = where(mine)
        rows = _by_series(of(mine), wanted.select("_sid", "metric", "series").distinct()).select("_sid", "ts", "value")
        told = wanted.select("_sid", "_gid", "_of", "_main", "_positive")
        adds.append(values(tm.range_columns(rows, specs, ["_sid"], chunk_us).join(told, "_sid"), list(specs)))
    facts = [
        {"_rule": i, "alertname": r.name, "severity": r.severity, "for_s": r.for_s, "_kind": r.kind, "_op": r.op,
         "_threshold": float(r.threshold)}
        for i, r in enumerate(rules)
    ]
    facts = samples.sparkSession.createDataFrame(pa.Table.from_pylist(facts, _FACTS))
    if adds:
        main, other = F.when(F.col("_main"), F.col("_v")), F.when(~F.col("_main"), F.col("_v"))
        # hardly any rows share an instant before the shuffle, so a sum there would only hold them all
        added = spread(union_all(adds).filter("_v IS NOT NULL"), ["_gid", "ts"])
        sums = added.groupBy("_gid", "ts").agg(
            F.sum(main).alias("_sum"), F.avg(main).alias("_avg"), F.max(main).alias("_max"), F.max(other).alias("_other"))
        told = readers.select("_gid", "_rule", "node", F.col("member").alias("series")).distinct()
        whole_ = sums.filter("_max IS NOT NULL").join(told, "_gid").join(facts.select("_rule", "_kind"), "_rule")
        whole_ = whole_.filter("_kind <> 'used' OR _other IS NOT NULL")
        out.append(whole_.select("_rule", "ts", "node", "series", _case("_kind", _GROUPED).alias("value")))
    met = _case("_op", {k: f"value {v} _threshold" for k, v in _OPS.items()})
    flags = union_all(out).join(facts, "_rule")
    return flags.select(*_KEYS, "value", F.coalesce(met, F.lit(False)).alias("active"))


def hold_for(flags: DataFrame, step_s: int, by: list[str] = FLAG, chunk_us: int = DAY) -> DataFrame:
    """Intervals in which a condition holds, and from when on it fires.

    ``flags`` has ``ts`` on a grid of ``step_s``, ``for_s`` and ``active``. The condition must
    hold at every grid point: an inactive or missing point ends the interval. It fires at the
    first grid point at least ``for_s`` after the start; before that it is pending.
    """
    step = seconds(step_s)
    held = merge_runs(flags.filter("active"), by, micros(F.col("ts")), step, chunk_us=chunk_us)
    wait = F.ceil(F.col("for_s") / F.lit(float(step_s))).cast("bigint") * step
    fires = F.col("start_us") + wait
    return held.select(
        *by,
        from_micros(F.col("start_us")).alias("pending_at"),
        F.when(fires <= F.col("end_us"), from_micros(fires)).alias("firing_at"),
        from_micros(F.col("end_us")).alias("last_at"),
        F.when(fires <= F.col("end_us"), "firing").otherwise("pending").alias("state"),
    )


def firing(held: DataFrame) -> DataFrame:
    """The intervals in which alerts fire, ``start_us`` to ``end_us``, both included."""
    on = held.filter(F.col("firing_at").isNotNull())
    ends = {"start_us": micros(F.col("firing_at")), "end_us": micros(F.col("last_at"))}
    return on.withColumns(ends).drop("pending_at", "firing_at", "last_at", "state")


def inhibit(fires: DataFrame, step_s: int, equal: list[str] = ("alertname", "node"), source: str = "critical",
            target: str = "warning", chunk_us: int = DAY) -> DataFrame:
    """Cut from each warning's firing intervals what lies in those of a critical alert with equal
    labels; intervals of other severities stay as they are."""
    quiet = F.col("severity") == target
    loud = fires.filter(F.col("severity") == source).select(*equal, "start_us", "end_us")
    left = cut_out(fires.filter(quiet), loud, list(equal), seconds(step_s), chunk_us)
    return fires.filter(~F.coalesce(quiet, F.lit(False))).unionByName(left)


def _by_severity(table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for sev, v in table.items():
        out = F.when(F.col("severity") == sev, v).otherwise(out)
    return out.cast("bigint") * 1_000_000


def notifications(fires: DataFrame, step_s: int, group: list[str] = ("alertname", "severity", "node"),
                  member: str = "series", chunk_us: int = DAY) -> DataFrame:
    """When a group of alerts is notified: ``first``, ``repeat``, ``update`` or ``resolved``.

    ``fires`` are firing intervals, after inhibition. A group is active while any member fires. It
    is announced once its wait is over, again after each repeat interval counted from there, and at
    the next group interval after a new member started to fire. A group that was announced is
    resolved at the first group interval after its last instant.
    """
    group = list(group)
    step = seconds(step_s)
    episodes = merge_intervals(fires, group, step, chunk_us)
    first = F.col("start_us") + _by_severity(GROUP_WAIT_S, DEFAULT_WAIT_S)
    told = episodes.withColumn("_first", first).filter(F.col("_first") <= F.col("end_us"))
    repeat = _by_severity(REPEAT_S, DEFAULT_REPEAT_S)
    calls = told.select(*group, "_first", F.explode(F.sequence("_first", "end_us", repeat)).alias("_at")).select(
        *group, "_at", F.when(F.col("_at") == F.col("_first"), "first").otherwise("repeat").alias("kind")
    )
    joins = merge_intervals(fires, group + [member], step, chunk_us).select(*group, F.col("start_us").alias("_joined"))
    every = seconds(GROUP_INTERVAL_S)
    over = F.col("_first") + (F.floor((F.col("end_us") - F.col("_first")) / F.lit(float(every))).cast("bigint") + 1) * every
    ends = told.select(*group, over.alias("_at"), F.lit("resolved").alias("kind"))
    behind = F.col("_joined") - F.col("_first")
    tick = F.col("_first") + F.ceil(behind / F.lit(float(every))).cast("bigint") * every
    within = asof_join(joins, told, group, F.col("_joined"), F.col("start_us"), ["_first", "end_us"], chunk_us)
    late = (F.col("_joined") > F.col("_first")) & (F.col("_joined") <= F.col("end_us"))
    updates = within.filter(late).withColumn("_at", tick).filter(F.col("_at") <= F.col("end_us")).select(
        *group, "_at", F.lit("update").alias("kind")
    ).distinct()
    return calls.unionByName(updates).unionByName(ends).select(*group, from_micros(F.col("_at")).alias("at"), "kind")
