"""Single-record transforms and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.types import map_types
from rowtide.operators import dlq
from rowtide.operators import transforms as tr
from rowtide.plans.logs import dirty_orders, document_log, mixed_log, orders, orders_log, sql
from rowtide.sources.tables import read_table

SINK = "sink-forward"


def _unwrap(deletes, tombstones=True):
    def run(spark, root):
        out = tr.unwrap(orders_log(spark, root), deletes, tombstones)
        return out.select(F.col("key.o_orderkey").alias("k"), "op", "lsn", "o_orderstatus", "o_totalprice")
    return run


def route_topics(spark, root):
    out = tr.route(mixed_log(spark, root), r"sqlserver\.[^.]+\.dbo\.(.+)", "$1")
    return out.groupBy("topic", "target").agg(F.count("*").alias("events"))


def parse_topic(spark, root):
    out = tr.parse_topic(mixed_log(spark, root))
    return out.groupBy(
        "topic", "name.prefix", "name.db", "name.schema", "name.table"
    ).agg(F.count("*").alias("events"))


def composite_key(spark, root):
    out = tr.assign_key(orders_log(spark, root), "shop.dbo.orders:o_custkey,o_orderpriority")
    return out.select("key.o_orderkey", F.col("source.lsn").alias("lsn"), "key_json")


def mask_pii(spark, root):
    return tr.mask_fields(read_table(spark, root, "customer"), ["c_name", "c_acctbal"])


def cast_or_dlq(spark, root):
    out = tr.cast_fields(dirty_orders(spark, root), {"price": "bigint"})
    return out.select("offset", "o_orderkey", "price", "cast_error")


def replace_fields(spark, root):
    return tr.replace_fields(orders(spark, root), ["o_orderpriority", "o_orderdate"], {"o_totalprice": "amount"})


def origin_filter(spark, root):
    """Events of site_a go away; the rest is tagged as site_b unless it already has an origin."""
    kept = tr.tag_origin(tr.drop_origin(orders_log(spark, root), "site_a"), "site_b")
    return kept.select(
        "key.o_orderkey", F.col("source.lsn").alias("lsn"), F.try_element_at("headers", F.lit("__origin")).alias("origin")
    )


def header_keys(spark, root):
    out = tr.header_keys(orders_log(spark, root))
    return out.select("key.o_orderkey", F.col("source.lsn").alias("lsn"), F.array_join("header_keys", ",").alias("keys"))


def event_outcomes(spark, root):
    return tr.event_outcomes(
        orders_log(spark, root).withColumn("key", F.when(F.col("key.o_orderkey") % 13 != 0, F.col("key"))),
        r".*\.dbo\.lineitem",
    )


def defaults_absent(spark, root):
    """Old records lack the priority and get its default; an explicit null of a new record stays."""
    k = F.col("o_orderkey")
    src = orders(spark, root).select(
        "o_orderkey", "o_orderstatus", F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 2 == 0, 1).otherwise(2).alias("schema_version"),
    )
    out = tr.apply_defaults(src, {"currency": "USD", "o_orderstatus": "pending"})
    return out.withColumn(
        "o_orderpriority",
        tr.default_for_version(F.col("o_orderpriority"), F.col("schema_version"), 2, "pending"),
    )


def map_types_query(spark, root):
    src = orders(spark, root).select(
        "o_orderkey", F.round(F.col("o_totalprice") * 100, 0).cast("bigint").cast("string").alias("cents"),
        F.rpad("o_orderstatus", 3, " ").alias("status"), F.col("o_custkey").cast("string").alias("customer"),
    )
    return map_types(src, {"cents": "DECIMAL(18,0)", "status": "CHAR(3)", "customer": "BIGINT"}).withColumn(
        "cents", F.col("cents").cast("bigint")).drop("type_error")


def map_types_errors(spark, root):
    """Values that do not fit their declared type are named, not lost in silence."""
    k = F.col("o_orderkey")
    src = orders(spark, root).select(
        "o_orderkey", F.when(k % 97 == 0, "N/A").otherwise(k.cast("string")).alias("amount"),
        F.when(k % 89 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("x"))).when(
            k % 83 != 0, F.col("o_custkey").cast("string")).alias("customer"))
    return map_types(src, {"amount": "DECIMAL(18,0)", "customer": "BIGINT"}).withColumn(
        "amount", F.col("amount").cast("bigint"))


def check_lengths(spark, root):
    out = tr.check_lengths(document_log(spark, root).withColumn("title", F.col("topic")), {"title": 4}, 4000, "value")
    return out.select("topic", "offset", F.coalesce("length_error", F.lit("ok")).alias("verdict"))


def scan_log(spark, root):
    lines = document_log(spark, root).select(
        F.col("offset").alias("doc_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    )
    return tr.scan_log(lines, "copyright|licen[sc]e", 20, ["doc_id", "line_no"])


def _rules():
    return [
        dlq.Rule("null_key", F.col("o_orderkey").isNull(), F.lit("null value for non-null column o_orderkey")),
        dlq.Rule("type_mismatch", F.col("price").isNotNull() & F.col("price").try_cast("bigint").isNull(),
                 F.concat(F.lit("Cannot convert "), "price", F.lit(" to BIGINT"))),
        dlq.Rule("constraint_violation", F.length("status") > 20, F.lit("status is longer than 20")),
    ]


def dlq_split(spark, root):
    """Every input row with the side it went to, and the reason if it is a dead letter."""
    good, bad = dlq.split_dlq(dirty_orders(spark, root), _rules(), SINK)
    return good.select("offset", F.lit("good").alias("side"), F.lit(None).cast("string").alias("cause"),
                       F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("message")).unionByName(
        bad.select("offset", F.lit("dlq").alias("side"), "error.cause",
                   F.element_at("context", "__connect.errors.stage").alias("stage"),
                   F.element_at("context", "__connect.errors.exception.message").alias("message")))


def dlq_summary(spark, root):
    return dlq.dlq_summary(dlq.split_dlq(dirty_orders(spark, root), _rules(), SINK)[1])


def source_skip(spark, root):
    return dlq.split_dlq(dirty_orders(spark, root), _rules(), SINK, mode="skip")[1]


def dlq_replay(spark, root):
    """Replay the type mismatches with the price repaired; the others stay where they are."""
    bad = dlq.split_dlq(dirty_orders(spark, root), _rules(), SINK)[1]
    fix = {"price": F.when(F.col("price") == "N/A", "0").otherwise(F.col("price"))}
    good, left = dlq.replay_dlq(bad, F.col("error.cause") == "type_mismatch", fix, _rules(), SINK)
    return good.select("offset", F.lit("applied").alias("fate"), F.lit("").alias("cause")).unionByName(
        left.select("offset", F.lit("dead").alias("fate"), "error.cause"))


def retention(spark, root):
    log = document_log(spark, root)
    now = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    kept = dlq.retain(log, now, 5 * 86400, 40_000, F.octet_length("value"), chunk_offsets=200)
    return kept.select("topic", "partition", "offset", F.octet_length("value").cast("bigint").alias("size"))


QUERIES = {
    "unwrap_drop": _unwrap("drop"),
    "unwrap_keep_deletes": _unwrap("keep"),
    "unwrap_with_tombstones": _unwrap("keep", False),
    "route_topics": route_topics,
    "parse_topic": parse_topic,
    "composite_key": composite_key,
    "mask_pii": mask_pii,
    "cast_or_dlq": cast_or_dlq,
    "replace_fields": replace_fields,
    "origin_filter": origin_filter,
    "header_keys": header_keys,
    "event_outcomes": event_outcomes,
    "defaults_absent": defaults_absent,
    "map_types": map_types_query,
    "map_types_errors": map_types_errors,
    "check_lengths": check_lengths,
    "scan_log": scan_log,
    "dlq_split": dlq_split,
    "dlq_summary": dlq_summary,
    "source_skip": source_skip,
    "dlq_replay": dlq_replay,
    "retention": retention,
}

_UNWRAP = "SELECT k, op, lsn, o_orderstatus, o_totalprice FROM orders_log"
_CAUSE = (
    "SELECT *, CASE WHEN o_orderkey IS NULL THEN 'null_key' WHEN TRY_CAST(price AS BIGINT) IS NULL AND price IS NOT NULL "
    "THEN 'type_mismatch' WHEN length(status) > 20 THEN 'constraint_violation' END AS cause FROM dirty_orders"
)
_STAGE = (
    "CASE cause WHEN 'null_key' THEN 'KEY_CONVERTER' WHEN 'type_mismatch' THEN 'VALUE_CONVERTER' "
    "WHEN 'constraint_violation' THEN 'TASK_PUT' END"
)

ORACLE = {
    "unwrap_drop": sql(_UNWRAP + " WHERE op IS NOT NULL AND op <> 'd'", "orders_log"),
    "unwrap_keep_deletes": sql(_UNWRAP + " WHERE op IS NOT NULL", "orders_log"),
    "unwrap_with_tombstones": sql(_UNWRAP, "orders_log"),
    "route_topics": sql("""
        SELECT topic, CASE WHEN topic LIKE 'sqlserver.%.dbo.%' THEN regexp_extract(topic, '^sqlserver\\.[^.]+\\.dbo\\.(.+)$', 1)
               ELSE topic END AS target, count(*) AS events FROM mixed_log GROUP BY ALL""", "mixed_log"),
    "parse_topic": sql("""
        SELECT topic, split_part(topic, '.', 1) AS prefix, CASE WHEN n = 4 THEN split_part(topic, '.', 2) END AS db,
               CASE WHEN n >= 3 THEN split_part(topic, '.', n - 1) END AS schema,
               CASE WHEN n >= 3 THEN split_part(topic, '.', n) END AS "table", count(*) AS events
        FROM (SELECT *, CAST(len(string_split(topic, '.')) AS INTEGER) AS n FROM mixed_log) GROUP BY ALL""", "mixed_log"),
    "composite_key": sql("""
        SELECT k AS o_orderkey, lsn, CASE WHEN o_orderkey IS NOT NULL THEN
          '{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}' END AS key_json
        FROM orders_log""", "orders_log"),
    "mask_pii": (
        "SELECT c_custkey, '' AS c_name, c_nationkey, CAST(0 AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"
    ),
    "cast_or_dlq": sql("""
        SELECT offs AS offset, o_orderkey, TRY_CAST(price AS BIGINT) AS price,
               CASE WHEN TRY_CAST(price AS BIGINT) IS NULL THEN 'price' END AS cast_error FROM dirty_orders""",
                       "dirty_orders"),
    "replace_fields": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS amount FROM orders",
    "origin_filter": sql(
        "SELECT k AS o_orderkey, lsn, 'site_b' AS origin FROM orders_log WHERE NOT home", "orders_log"),
    "header_keys": sql(
        "SELECT k AS o_orderkey, lsn, CASE WHEN home THEN '__origin,trace' END AS keys FROM orders_log", "orders_log"),
    "event_outcomes": sql("""
        SELECT 'sqlserver.shop.dbo.orders' AS topic, coalesce(op, 'tombstone') AS op,
               CASE WHEN k % 13 = 0 THEN 'erroneous' WHEN op IS NULL THEN 'skipped' ELSE 'passed' END AS outcome,
               count(*) AS events FROM orders_log GROUP BY ALL""", "orders_log"),
    "defaults_absent": """
        SELECT o_orderkey, o_orderstatus,
               CASE WHEN o_orderkey % 2 = 0 THEN 'pending' WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END
               AS o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS schema_version,
               'USD' AS currency FROM orders""",
    "map_types": """
        SELECT o_orderkey, CAST(round(o_totalprice * 100, 0) AS BIGINT) AS cents, o_orderstatus AS status,
               o_custkey AS customer FROM orders""",
    "map_types_errors": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS amount,
               CASE WHEN o_orderkey % 89 <> 0 AND o_orderkey % 83 <> 0 THEN o_custkey END AS customer,
               CASE WHEN o_orderkey % 97 = 0 THEN 'amount' WHEN o_orderkey % 89 = 0 THEN 'customer' END AS type_error
        FROM orders""",
    "check_lengths": """
        SELECT source AS topic, doc_id AS offset, CASE WHEN strlen(text) > 4000 THEN 'message'
               WHEN length(source) > 4 THEN 'title' ELSE 'ok' END AS verdict FROM documents""",
    "scan_log": """
        SELECT doc_id, line_no, line FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents)
        WHERE regexp_matches(line, '(?i)copyright|licen[sc]e') ORDER BY doc_id DESC, line_no DESC LIMIT 20""",
    "dlq_split": sql(f"""
        SELECT offs AS offset, CASE WHEN cause IS NULL THEN 'good' ELSE 'dlq' END AS side, cause, {_STAGE} AS stage,
               CASE cause WHEN 'null_key' THEN 'null value for non-null column o_orderkey'
                    WHEN 'type_mismatch' THEN 'Cannot convert ' || price || ' to BIGINT'
                    WHEN 'constraint_violation' THEN 'status is longer than 20' END AS message
        FROM caused""", "dirty_orders", caused=_CAUSE),
    "dlq_summary": sql(f"""
        SELECT 'sink-forward' AS sink, {_STAGE} AS stage, cause, count(*) AS records FROM caused
        WHERE cause IS NOT NULL GROUP BY ALL""", "dirty_orders", caused=_CAUSE),
    "source_skip": sql(
        "SELECT cause, count(*) AS skipped FROM caused WHERE cause IS NOT NULL GROUP BY cause",
        "dirty_orders", caused=_CAUSE),
    "dlq_replay": sql("""
        SELECT offs AS offset, CASE WHEN cause = 'type_mismatch' AND length(status) <= 20 THEN 'applied' ELSE 'dead' END AS fate,
               CASE WHEN cause <> 'type_mismatch' THEN cause WHEN length(status) > 20 THEN 'constraint_violation' ELSE '' END
               AS cause FROM caused WHERE cause IS NOT NULL""", "dirty_orders", caused=_CAUSE),
    "retention": sql("""
        SELECT topic, part AS partition, offs AS offset, size FROM (
          SELECT *, sum(size) OVER (PARTITION BY topic, part ORDER BY offs DESC) AS run FROM document_log
          WHERE ts >= TIMESTAMP '2024-01-03 00:00:00') WHERE run <= 40000""", "document_log"),
}
