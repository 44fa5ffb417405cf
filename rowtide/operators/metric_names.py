"""Bean strings to metric name, type and labels.

Rules are tried in order and the first that matches anywhere in the string wins. A rule is one
``regexp_replace`` that writes ``name \\x01 type \\x01 table \\x01 label \\x02 value ...`` in a
single go; no string is parsed twice and nothing leaves the JVM. Attributes with a name of their
own are looked up in the rule's table afterwards, so a connector needs one rule and not one per
attribute.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD, _PAIR = "\x01", "\x02"


@dataclass(frozen=True)
class MetricRule:
    pattern: str
    name: str
    type: str = "GAUGE"
    labels: dict[str, str] = field(default_factory=dict)
    table: str = ""

    def whole(self) -> str:
        return f"^.*?(?:{self.pattern}).*$"

    def replacement(self) -> str:
        pairs = [f"{k}{_PAIR}{v}" for k, v in self.labels.items()]
        return _FIELD.join([self.name, self.type, self.table, *pairs])


# Bean heads of the change-capture connectors, their labels, and the names of the
# attributes that have one of their own. Every other attribute goes through the catch-all rules.
SQLSERVER_HEAD = (
    r"debezium\.sql_server<type=connector-metrics, server=([^,]+), task=([^,]+), context=([^,]+), "
    r"database=([^>]+)><>"
)
SQLSERVER_LABELS = {"connector": "$1", "task": "$2", "context": "$3", "database": "$4", "plugin": "sqlserver"}
SQLSERVER_SHORT_HEAD = r"debezium\.sql_server<type=connector-metrics, server=([^,]+), task=([^,]+), context=([^>]+)><>"
POSTGRES_HEAD = r"debezium\.postgres<type=connector-metrics, context=([^,]+), server=([^>]+)><>"
POSTGRES_LABELS = {"context": "$1", "connector": "$2", "plugin": "postgres"}
ATTRIBUTES = [
    ("MilliSecondsBehindSource", "milliseconds_behind_source", "GAUGE"),
    ("MilliSecondsSinceLastEvent", "milliseconds_since_last_event", "GAUGE"),
    ("TotalNumberOfEventsSeen", "total_number_of_events_seen", "COUNTER"),
    ("TotalNumberOfCreateEventsSeen", "total_number_of_create_events_seen", "COUNTER"),
    ("TotalNumberOfUpdateEventsSeen", "total_number_of_update_events_seen", "COUNTER"),
    ("TotalNumberOfDeleteEventsSeen", "total_number_of_delete_events_seen", "COUNTER"),
    ("NumberOfErroneousEvents", "number_of_erroneous_events", "COUNTER"),
    ("NumberOfEventsFiltered", "number_of_events_filtered", "COUNTER"),
    ("NumberOfCommittedTransactions", "number_of_committed_transactions", "COUNTER"),
    ("QueueRemainingCapacity", "queue_remaining_capacity", "GAUGE"),
    ("QueueTotalCapacity", "queue_total_capacity", "GAUGE"),
    ("RemainingTableCount", "remaining_table_count", "GAUGE"),
    ("TotalTableCount", "total_table_count", "GAUGE"),
    ("RowsScanned", "rows_scanned", "COUNTER"),
]
POSTGRES_ATTRIBUTES = {
    "MilliSecondsBehindSource", "MilliSecondsSinceLastEvent", "TotalNumberOfCreateEventsSeen",
    "TotalNumberOfUpdateEventsSeen", "TotalNumberOfDeleteEventsSeen", "NumberOfErroneousEvents",
    "NumberOfEventsFiltered",
}


def _attribute(names: list[str]) -> str:
    """One group for the attribute; a name of its own is found even as the start of a longer one."""
    return "(" + "|".join(names) + "|[^:]+)"


def _capture_rules() -> list[MetricRule]:
    every = [a for a, _, _ in ATTRIBUTES]
    some = [a for a in every if a in POSTGRES_ATTRIBUTES]
    short = {"connector": "$1", "task": "$2", "context": "$3", "plugin": "sqlserver"}
    return [
        MetricRule(SQLSERVER_HEAD + _attribute(every), "debezium_metrics_$5", "GAUGE", SQLSERVER_LABELS, "sqlserver"),
        MetricRule(SQLSERVER_SHORT_HEAD + "([^:]+)", "debezium_metrics_$4", "GAUGE", short),
        MetricRule(POSTGRES_HEAD + _attribute(some), "debezium_metrics_$3", "GAUGE", POSTGRES_LABELS, "postgres"),
    ]


def _own_names() -> Column:
    """(table, raw name) -> name and type."""
    pairs = []
    for attribute, name, kind in ATTRIBUTES:
        for table in ("sqlserver", "postgres"):
            if table == "sqlserver" or attribute in POSTGRES_ATTRIBUTES:
                pairs.append(F.lit(f"{table}/debezium_metrics_{attribute}"))
                pairs.append(F.struct(F.lit("debezium_metrics_" + name).alias("name"), F.lit(kind).alias("type")))
    return F.create_map(*pairs)


# Rules of the workers and their JVM, in order, as (pattern, name, type, labels).
WORKER_RULES = [
    (r"kafka\.connect<type=connect-worker-metrics, connector=([^>]+)><>([^:]+)", "kafka_connect_connector_metrics_$2", "GAUGE", {"connector": "$1"}),
    (r"kafka\.connect<type=connect-worker-metrics><>([^:]+)", "kafka_connect_connect_worker_metrics_$1", "GAUGE", {}),
    (r"kafka\.connect<type=connect-worker-rebalance-metrics><>([^:]+)", "kafka_connect_worker_rebalance_$1", "GAUGE", {}),
    (r"kafka\.connect<type=sink-task-metrics, connector=([^,]+), task=([^>]+)><>([^:]+)",
     "kafka_connect_sink_task_metrics_$3", "GAUGE", {"connector": "$1", "task": "$2"}),
    (r"kafka\.connect<type=source-task-metrics, connector=([^,]+), task=([^>]+)><>([^:]+)",
     "kafka_connect_source_task_metrics_$3", "GAUGE", {"connector": "$1", "task": "$2"}),
    (r"kafka\.connect<type=task-error-metrics, connector=([^,]+), task=([^>]+)><>([^:]+)",
     "kafka_connect_task_error_metrics_$3", "GAUGE", {"connector": "$1", "task": "$2"}),
    (r"kafka\.connect<type=task-metrics, connector=([^,]+), task=([^>]+)><>([^:]+)",
     "kafka_connect_task_metrics_$3", "GAUGE", {"connector": "$1", "task": "$2"}),
    (r"kafka\.consumer<type=consumer-fetch-manager-metrics, client-id=([^,]+), topic=([^,]+), partition=([^>]+)><>([^:]+)",
     "kafka_consumer_consumer_fetch_manager_metrics_$4", "GAUGE", {"client_id": "$1", "topic": "$2", "partition": "$3"}),
    (r"kafka\.consumer<type=consumer-fetch-manager-metrics, client-id=([^>]+)><>([^:]+)",
     "kafka_consumer_consumer_fetch_manager_metrics_$2", "GAUGE", {"client_id": "$1"}),
    (r"java\.lang<type=Memory><HeapMemoryUsage>(.+)", "jvm_memory_heap_$1", "GAUGE", {}),
    (r"java\.lang<type=Memory><NonHeapMemoryUsage>(.+)", "jvm_memory_nonheap_$1", "GAUGE", {}),
    (r"java\.lang<type=MemoryPool, name=([^>]+)><Usage>(.+)", "jvm_memory_pool_$2", "GAUGE", {"pool": "$1"}),
    (r"java\.lang<type=GarbageCollector, name=([^>]+)><>CollectionCount", "jvm_gc_collection_count", "COUNTER", {"gc": "$1"}),
    (r"java\.lang<type=GarbageCollector, name=([^>]+)><>CollectionTime", "jvm_gc_collection_time_ms", "COUNTER", {"gc": "$1"}),
    (r"java\.lang<type=Threading><>([^:]+)", "jvm_threading_$1", "GAUGE", {}),
    (r"java\.lang<type=OperatingSystem><>([^:]+)", "jvm_os_$1", "GAUGE", {}),
]

# Rules of the brokers and their JVM, in order, as (pattern, name, type, labels).
BROKER_RULES = [
    ("kafka.server<type=BrokerTopicMetrics, name=(.+), topic=(.+)><>Count", "kafka_server_brokertopicmetrics_$1", "COUNTER", {"topic": "$2"}),
    ("kafka.server<type=BrokerTopicMetrics, name=(.+)><>Count", "kafka_server_brokertopicmetrics_$1", "COUNTER", {}),
    ("kafka.server<type=BrokerTopicMetrics, name=(.+), topic=(.+)><>OneMinuteRate",
     "kafka_server_brokertopicmetrics_$1_rate", "GAUGE", {"topic": "$2"}),
    ("kafka.server<type=BrokerTopicMetrics, name=(.+)><>OneMinuteRate", "kafka_server_brokertopicmetrics_$1_rate", "GAUGE", {}),
    ("kafka.server<type=ReplicaManager, name=(.+)><>Value", "kafka_server_replicamanager_$1", "GAUGE", {}),
    ("kafka.server<type=KafkaRequestHandlerPool, name=(.+)><>OneMinuteRate", "kafka_server_kafkarequesthandlerpool_$1", "GAUGE", {}),
    ("kafka.server<type=KafkaRequestHandlerPool, name=(.+)><>Count", "kafka_server_kafkarequesthandlerpool_$1_total", "COUNTER", {}),
    ("kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>99thPercentile",
     "kafka_network_requestmetrics_$1", "GAUGE", {"request": "$2", "quantile": "0.99"}),
    ("kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>95thPercentile",
     "kafka_network_requestmetrics_$1", "GAUGE", {"request": "$2", "quantile": "0.95"}),
    ("kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>75thPercentile",
     "kafka_network_requestmetrics_$1", "GAUGE", {"request": "$2", "quantile": "0.75"}),
    ("kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>50thPercentile",
     "kafka_network_requestmetrics_$1", "GAUGE", {"request": "$2", "quantile": "0.50"}),
    ("kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>Count", "kafka_network_requestmetrics_$1_total", "GAUGE", {"request": "$2"}),
    ("kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>Mean", "kafka_network_requestmetrics_$1_mean", "GAUGE", {"request": "$2"}),
    ("kafka.network<type=SocketServer, name=(.+)><>Value", "kafka_network_socketserver_$1", "GAUGE", {}),
    ("kafka.network<type=SocketServer, name=(.+)><>Count", "kafka_network_socketserver_$1", "COUNTER", {}),
    ("kafka.controller<type=KafkaController, name=(.+)><>Value", "kafka_controller_kafkacontroller_$1", "GAUGE", {}),
    ("kafka.controller<type=ControllerStats, name=(.+)><>Count", "kafka_controller_controllerstats_$1", "COUNTER", {}),
    ("kafka.controller<type=ControllerStats, name=(.+)><>OneMinuteRate", "kafka_controller_controllerstats_$1_rate", "GAUGE", {}),
    ("kafka.log<type=LogManager, name=(.+)><>Value", "kafka_log_logmanager_$1", "GAUGE", {}),
    ("kafka.log<type=Log, name=(.+), topic=(.+), partition=(.+)><>Value", "kafka_log_log_$1", "GAUGE", {"topic": "$2", "partition": "$3"}),
    ("kafka.server<type=DelayedOperationPurgatory, name=(.+), delayedOperation=(.+)><>Value",
     "kafka_server_delayedoperationpurgatory_$1", "GAUGE", {"delayed_operation": "$2"}),
    ("kafka.coordinator.group<type=GroupMetadataManager, name=(.+)><>Value", "kafka_coordinator_group_groupmetadatamanager_$1", "GAUGE", {}),
    (r"java\.lang<type=Memory><HeapMemoryUsage>(\w+)", "jvm_memory_heap_$1", "GAUGE", {}),
    (r"java\.lang<type=Memory><NonHeapMemoryUsage>(\w+)", "jvm_memory_nonheap_$1", "GAUGE", {}),
    (r"java\.lang<type=MemoryPool, name=(.+)><Usage>(\w+)", "jvm_memory_pool_$2", "GAUGE", {"pool": "$1"}),
    (r"java\.lang<type=GarbageCollector, name=(.+)><CollectionCount>", "jvm_gc_collection_count", "COUNTER", {"gc": "$1"}),
    (r"java\.lang<type=GarbageCollector, name=(.+)><CollectionTime>", "jvm_gc_collection_time_ms", "COUNTER", {"gc": "$1"}),
    (r"java\.lang<type=Threading><(\w+)>", "jvm_threading_$1", "GAUGE", {}),
    (r"java\.lang<type=OperatingSystem><(\w+)>", "jvm_os_$1", "GAUGE", {}),
]

# Rules of the schema registry and its JVM, in order, as (pattern, name, type, labels).
REGISTRY_RULES = [
    (r"kafka\.schema\.registry<type=jetty-metrics><>([^:]+)", "kafka_schema_registry_jetty_$1", "GAUGE", {}),
    (r"kafka\.schema\.registry<type=jersey-metrics><>(.+)\.(request-[^:]+|response-[^:]+)",
     "kafka_schema_registry_jersey_$2", "GAUGE", {"endpoint": "$1"}),
    (r"kafka\.schema\.registry<type=master-slave-role><>([^:]+)", "kafka_schema_registry_master_slave_role", "GAUGE", {}),
    (r"kafka\.schema\.registry<type=([^,>]+)><>([^:]+)", "kafka_schema_registry_$1", "GAUGE", {}),
    (r"kafka\.producer<type=producer-metrics, client-id=([^>]+)><>([^:]+)", "kafka_schema_registry_producer_$2", "GAUGE", {"client_id": "$1"}),
    (r"kafka\.consumer<type=consumer-fetch-manager-metrics, client-id=([^>]+)><>([^:]+)",
     "kafka_schema_registry_consumer_$2", "GAUGE", {"client_id": "$1"}),
    (r"kafka\.consumer<type=consumer-coordinator-metrics, client-id=([^>]+)><>([^:]+)",
     "kafka_schema_registry_consumer_coordinator_$2", "GAUGE", {"client_id": "$1"}),
    (r"java\.lang<type=Memory><HeapMemoryUsage>(.+)", "jvm_memory_heap_$1", "GAUGE", {}),
    (r"java\.lang<type=Memory><NonHeapMemoryUsage>(.+)", "jvm_memory_nonheap_$1", "GAUGE", {}),
    (r"java\.lang<type=MemoryPool, name=([^>]+)><Usage>(.+)", "jvm_memory_pool_$2", "GAUGE", {"pool": "$1"}),
    (r"java\.lang<type=GarbageCollector, name=([^>]+)><>CollectionCount", "jvm_gc_collection_count", "COUNTER", {"gc": "$1"}),
    (r"java\.lang<type=GarbageCollector, name=([^>]+)><>CollectionTime", "jvm_gc_collection_time_ms", "COUNTER", {"gc": "$1"}),
    (r"java\.lang<type=Threading><>([^:]+)", "jvm_threading_$1", "GAUGE", {}),
    (r"java\.lang<type=OperatingSystem><>([^:]+)", "jvm_os_$1", "GAUGE", {}),
]


def _rules(rows: list[tuple[str, str, str, dict[str, str]]]) -> list[MetricRule]:
    return [MetricRule(*row) for row in rows]


def connect_rules() -> list[MetricRule]:
    return _capture_rules() + _rules(WORKER_RULES)


def broker_rules() -> list[MetricRule]:
    return _rules(BROKER_RULES)


def registry_rules() -> list[MetricRule]:
    return _rules(REGISTRY_RULES)


def _rewritten(bean: Column, rules: list[MetricRule]) -> Column:
    out = None
    for r in rules:
        text = F.regexp_replace(bean, r.whole(), r.replacement())
        cond = bean.rlike(r.pattern)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def normalise_metrics(lines: DataFrame, rules: list[MetricRule], bean: str = "bean") -> DataFrame:
    """Add ``metric``, ``type`` and ``labels``; lines no rule matches are left out.

    Names are lower case, and characters a metric name cannot hold become underscores.
    """
    # exploding a list of one keeps the optimizer from copying the rules into every use below
    hit = lines.select("*", F.explode(F.array_compact(F.array(_rewritten(F.col(bean), rules)))).alias("_text"))
    parts = F.split("_text", _FIELD, 4)
    raw, kind, table, pairs = (F.get(parts, F.lit(i)) for i in range(4))
    own = F.try_element_at(_own_names(), F.concat_ws("/", table, raw))
    plain = F.regexp_replace(F.lower(raw), "[^a-z0-9_:]", "_")
    empty = F.create_map().cast("map<string,string>")
    labels = F.when(pairs.isNull(), empty).otherwise(F.str_to_map(pairs, F.lit(_FIELD), F.lit(_PAIR)))
    return hit.withColumns(
        {"metric": F.coalesce(own["name"], plain), "type": F.coalesce(own["type"], kind), "labels": labels}
    ).drop("_text")
