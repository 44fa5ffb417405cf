"""Snapshots, logs, topics, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowtide.operators.apply import net_changes
from rowtide.plans.logs import NEW_KEY, ORDER_COLS, STRIDE, TOPIC, mixed_log, orders, orders_log, sql
from rowtide.sources import changes as ch
from rowtide.sources.tables import load_table, read_table, run_dir, save_table


def snapshot_events(spark, root):
    ev = ch.snapshot_events(read_table(spark, root, "customer"), "sqlserver.shop.dbo.customer", ["c_custkey"], 7)
    return ev.select(
        "topic", "key.c_custkey", "op", F.col("source.lsn").alias("lsn"), F.col("source.table").alias("tbl"),
        F.col("source.snapshot").alias("is_snapshot"), "after.c_name", "after.c_acctbal",
    )


def _bootstrap(mode, has_offsets=False):
    def run(spark, root):
        snap = ch.snapshot_events(orders(spark, root), TOPIC, ["o_orderkey"], 15, F.col("o_orderdate"))
        # the image of a delete is null in the log, so both sides share one struct type
        log = orders_log(spark, root)
        snap = snap.withColumn("before", F.col("before").cast(log.schema["before"].dataType))
        out = ch.bootstrap(snap, log, mode, 15, has_offsets)
        return out.select("key.o_orderkey", "op", F.col("source.lsn").alias("lsn"), "after.o_orderstatus")
    return run


def diff_capture(spark, root):
    old = orders(spark, root)
    k = F.col("o_orderkey")
    kept = old.filter(k % 17 != 0).withColumn(
        "o_orderstatus", F.when(k % 19 == 0, "X").otherwise(F.col("o_orderstatus"))
    )
    added = old.filter(k % 23 == 0).withColumn("o_orderkey", k + NEW_KEY)
    ev = ch.diff_capture(old, kept.unionByName(added), TOPIC, ["o_orderkey"], 5)
    return ev.select(
        "key.o_orderkey", "op", F.col("before.o_orderstatus").alias("before_status"),
        F.col("after.o_orderstatus").alias("after_status"), F.col("after.o_totalprice").alias("after_price"),
    )


def tree_capture(spark, root):
    """The same by a tree of digests; the new version has a column more and differs in few leaves."""
    old, k = orders(spark, root), F.col("o_orderkey")
    new = old.where(k % 6000 != 11).withColumn("note", F.when(k % 4000 == 9, "n"))
    ev = ch.diff_capture(old, new, TOPIC, ["o_orderkey"], 5, leaf_bits=6)
    return ev.select("key.o_orderkey", "op", "before.o_orderstatus", F.col("after.note").alias("note"), F.col("before.note").alias("before_note"))


def net(spark, root):
    out = net_changes(orders_log(spark, root), ["o_orderkey"], 10, 50)
    return out.select("o_orderkey", "op", "lsn", "after.o_orderstatus", "after.o_totalprice")


def net_all(spark, root):
    out = net_changes(orders_log(spark, root), ["o_orderkey"], 0, 30)
    return out.select("o_orderkey", "op", "lsn", "after.o_orderstatus")


def include_exclude(spark, root):
    log = orders_log(spark, root).select("source", "op")
    mixed = mixed_log(spark, root).select(
        F.struct(
            F.lit("shop").alias("db"), F.split_part("topic", F.lit("."), F.lit(-2)).alias("schema"),
            F.split_part("topic", F.lit("."), F.lit(-1)).alias("table"),
        ).alias("source"), "op")
    slim = log.select(F.struct("source.db", "source.schema", "source.table").alias("source"), "op").unionByName(mixed)
    chosen = ch.select_tables(slim, include=["dbo.orders", "public.supplier"], exclude=["dbo.orders"])
    others = ch.select_tables(slim, exclude=["dbo.orders"], schemas=["dbo", "sales"])
    both = chosen.select(F.lit("include").alias("list"), "source").unionByName(
        others.select(F.lit("exclude").alias("list"), "source"))
    return both.groupBy("list", "source.schema", "source.table").agg(F.count("*").alias("events"))


def subscribe(spark, root):
    got = ch.subscribe(mixed_log(spark, root), r"sqlserver\..*\.dbo\..*")
    return got.select("topic", "partition", "offset", "op", "key")


def replay(spark, root):
    log = orders_log(spark, root)
    ranges = spark.createDataFrame(
        [(TOPIC, 0, 10 * STRIDE, 31 * STRIDE), (TOPIC, 1, None, 10 * STRIDE)],
        "topic string, partition int, start bigint, end bigint",
    )
    return ch.replay(log, ranges).select("partition", "offset", "key.o_orderkey", "op")


def tail_topic(spark, root):
    return ch.tail_topic(mixed_log(spark, root), 5).select("topic", "partition", "offset", "key", "op")


def head_topic(spark, root):
    return ch.head_topic(mixed_log(spark, root), 5).select("topic", "partition", "offset", "key", "op")


def topic_catalog(spark, root):
    return ch.topic_catalog(mixed_log(spark, root))


V1 = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
V2 = V1 + ", o_orderpriority string"


def decode_versions(spark, root):
    """JSON written with two schema versions; some values are cut off or name no known version."""
    k = F.col("o_orderkey")
    ver = F.when(k % 97 == 0, 9).when(k % 2 == 0, 1).otherwise(2)
    both = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    old = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    text = F.when(ver == 1, old).otherwise(both)
    log = orders(spark, root).select(
        k.alias("k"), ver.alias("schema_version"),
        F.when(k % 89 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value"),
    )
    registry = {1: StructType.fromDDL(V1), 2: StructType.fromDDL(V2)}
    out = ch.decode(log, registry)
    return out.select("k", "schema_version", "decode_ok", "after.o_orderstatus", "after.o_totalprice",
                      "after.o_orderpriority")


def bucketed_table(spark, root):
    """A table saved in key buckets and loaded again."""
    path = run_dir(spark, "orders-by-key")
    save_table(orders(spark, root), path, ["o_orderkey"], 16)
    return load_table(spark, path).select(*ORDER_COLS)


QUERIES = {
    "snapshot_events": snapshot_events,
    "bootstrap_initial": _bootstrap("initial"),
    "bootstrap_no_data": _bootstrap("no_data"),
    "bootstrap_resume": _bootstrap("initial", has_offsets=True),
    "diff_capture": diff_capture,
    "tree_capture": tree_capture,
    "net_changes": net,
    "net_changes_with_snapshot": net_all,
    "include_exclude": include_exclude,
    "subscribe_topics": subscribe,
    "replay_range": replay,
    "tail_topic": tail_topic,
    "head_topic": head_topic,
    "topic_catalog": topic_catalog,
    "decode_versions": decode_versions,
    "bucketed_table": bucketed_table,
}

_EDGE = (
    "SELECT topic, part AS partition, offs AS offset, key, op FROM (SELECT *, row_number() OVER "
    "(PARTITION BY topic ORDER BY offs {d}, part {d}) AS n FROM mixed_log) WHERE n <= 5"
)
_NET = """
SELECT k AS o_orderkey, CASE WHEN last_op = 'd' THEN 'd' WHEN first_op IN ('c', 'r') THEN 'c' ELSE 'u' END AS op,
       lsn, o_orderstatus{extra}
FROM (
  SELECT *, op AS last_op,
         first_value(op) OVER (PARTITION BY k ORDER BY lsn, offs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_op,
         row_number() OVER (PARTITION BY k ORDER BY lsn DESC, offs DESC) AS n
  FROM orders_log WHERE op IS NOT NULL AND lsn BETWEEN {a} AND {b}
) WHERE n = 1 AND NOT (first_op IN ('c', 'r') AND last_op = 'd')
"""

ORACLE = {
    "snapshot_events": (
        "SELECT 'sqlserver.shop.dbo.customer' AS topic, c_custkey, 'r' AS op, CAST(7 AS BIGINT) AS lsn, 'customer' AS tbl, "
        "true AS is_snapshot, c_name, c_acctbal FROM customer"
    ),
    "bootstrap_initial": sql(
        "SELECT o_orderkey, 'r' AS op, CAST(15 AS BIGINT) AS lsn, o_orderstatus FROM orders UNION ALL "
        "SELECT k, op, lsn, o_orderstatus FROM orders_log WHERE lsn > 15", "orders_log"),
    "bootstrap_no_data": sql("SELECT k AS o_orderkey, op, lsn, o_orderstatus FROM orders_log", "orders_log"),
    "bootstrap_resume": sql("SELECT k AS o_orderkey, op, lsn, o_orderstatus FROM orders_log", "orders_log"),
    "tree_capture": """
        SELECT o_orderkey, 'd' AS op, o_orderstatus, NULL AS note, NULL AS before_note FROM orders WHERE o_orderkey % 6000 = 11
        UNION ALL SELECT o_orderkey, 'u', o_orderstatus, 'n', NULL FROM orders WHERE o_orderkey % 4000 = 9 AND o_orderkey % 6000 <> 11""",
    "diff_capture": f"""
        SELECT o_orderkey, 'd' AS op, o_orderstatus AS before_status, NULL AS after_status, NULL AS after_price
        FROM orders WHERE o_orderkey % 17 = 0
        UNION ALL SELECT o_orderkey, 'u', o_orderstatus, 'X', o_totalprice FROM orders
        WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 AND o_orderstatus <> 'X'
        UNION ALL SELECT o_orderkey + {NEW_KEY}, 'c', NULL, o_orderstatus, o_totalprice FROM orders
        WHERE o_orderkey % 23 = 0""",
    "net_changes": sql(_NET.format(a=10, b=50, extra=", o_totalprice"), "orders_log"),
    "net_changes_with_snapshot": sql(_NET.format(a=0, b=30, extra=""), "orders_log"),
    "include_exclude": sql("""
        SELECT 'include' AS list, schema, "table", count(*) AS events FROM slim
        WHERE (schema = 'dbo' AND "table" = 'orders') OR (schema = 'public' AND "table" = 'supplier') GROUP BY ALL
        UNION ALL SELECT 'exclude', schema, "table", count(*) FROM slim
        WHERE schema IN ('dbo', 'sales') AND NOT (schema = 'dbo' AND "table" = 'orders') GROUP BY ALL
        """, "orders_log", "mixed_log",
        slim="""SELECT 'dbo' AS schema, 'orders' AS "table" FROM orders_log
                UNION ALL SELECT split_part(topic, '.', -2), split_part(topic, '.', -1) FROM mixed_log"""),
    "subscribe_topics": sql(
        "SELECT topic, part AS partition, offs AS offset, op, key FROM mixed_log "
        "WHERE topic LIKE 'sqlserver.%.dbo.%'", "mixed_log"),
    "replay_range": sql(
        "SELECT part AS partition, offs AS offset, k AS o_orderkey, op FROM orders_log "
        f"WHERE (part = 0 AND offs >= {10 * STRIDE} AND offs < {31 * STRIDE}) OR (part = 1 AND offs < {10 * STRIDE})",
        "orders_log"),
    "tail_topic": sql(_EDGE.format(d="DESC"), "mixed_log"),
    "head_topic": sql(_EDGE.format(d="ASC"), "mixed_log"),
    "topic_catalog": sql("""
        SELECT topic, part AS partition, max(offs) + 1 AS end_offset, count(*) AS records,
               CASE WHEN topic LIKE 'dlq-%' THEN 'dlq' WHEN topic LIKE '\\_schema-history-%' ESCAPE '\\' THEN 'history'
                    WHEN topic LIKE 'connect-%' THEN 'internal'
                    WHEN topic LIKE 'sqlserver.%' OR topic LIKE 'aurora.%' THEN 'cdc' ELSE 'other' END AS class
        FROM mixed_log GROUP BY topic, part""", "mixed_log"),
    "decode_versions": """
        SELECT k, schema_version, ok AS decode_ok, CASE WHEN ok THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN ok THEN o_totalprice END AS o_totalprice,
               CASE WHEN ok AND schema_version = 2 THEN o_orderpriority END AS o_orderpriority
        FROM (SELECT *, o_orderkey AS k, schema_version <> 9 AND o_orderkey % 89 <> 0 AS ok
              FROM (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 9 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END
                           AS schema_version FROM orders))""",
    "bucketed_table": "SELECT * FROM orders",
}
