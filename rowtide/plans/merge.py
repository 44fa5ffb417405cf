"""Applying change logs to tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowtide.operators import apply as ap
from rowtide.operators.transforms import route, tag_origin
from rowtide.operators.reconcile import loop_check as find_echoes
from rowtide.plans.logs import ORDER_COLS, mixed_log, orders, orders_log, sql
from rowtide.sources.changes import select_tables
from rowtide.sources.tables import read_table

KEY = ["o_orderkey"]
PERSON = StructType().add("name", "string").add("bal", "double")
SCHEMAS = {"customer": PERSON, "supplier": PERSON, "part": StructType().add("name", "string").add("size", "integer")}


def _upsert(deletes):
    def run(spark, root):
        return ap.live(ap.upsert(None, orders_log(spark, root), KEY, deletes)).select(*ORDER_COLS)
    return run


def onto_target(spark, root):
    """Later changes applied to a target that already holds the snapshot."""
    log = orders_log(spark, root)
    target = ap.as_state(orders(spark, root), lsn=0)
    return ap.live(ap.upsert(target, log.filter(F.col("source.lsn") > 0), KEY, "apply")).select(*ORDER_COLS)


def redelivery(spark, root):
    """The log delivered twice, in two parts, newest part first: same state as once in order."""
    log = orders_log(spark, root)
    newer, older = log.filter(F.col("source.lsn") >= 20), log.filter(F.col("source.lsn") <= 30)
    first = ap.upsert(None, newer.unionByName(newer), KEY, "apply")
    return ap.live(ap.upsert(first, older.unionByName(log), KEY, "apply")).select(*ORDER_COLS)


def dedupe(spark, root):
    once = ap.dedupe_delivery(orders_log(spark, root).select("topic", "partition", "offset", "op"))
    return once.groupBy("partition", F.coalesce("op", F.lit("tombstone")).alias("op")).agg(F.count("*").alias("events"))


def evolve_columns(spark, root):
    """A writer on schema 2 knows the priority, one on schema 1 does not. Newer events of the old
    writer keep the priority; an explicit null of the new writer overwrites it."""
    src = orders(spark, root)
    k = F.col("o_orderkey")
    rows = src.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.inline(F.array_compact(F.array(
            F.struct(F.lit(1).alias("lsn"), F.lit(2).alias("sv"), F.lit(False).alias("blank")),
            F.when(k % 5 == 0, F.struct(F.lit(2).alias("lsn"), F.lit(2).alias("sv"), F.lit(True).alias("blank"))),
            F.when(k % 3 == 0, F.struct(F.lit(3).alias("lsn"), F.lit(1).alias("sv"), F.lit(False).alias("blank"))),
        ))),
    )
    state = rows.select(
        "o_orderkey",
        F.when(F.col("lsn") == 3, "N").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when((F.col("sv") == 2) & ~F.col("blank"), F.col("o_orderpriority")).alias("o_orderpriority"),
        F.struct(F.col("lsn").cast("bigint").alias("lsn")).alias("_version"),
        F.lit(False).alias("_deleted"), F.col("sv").alias("_schema_version"),
    )
    return ap.live(ap.latest(state, KEY, {"o_orderpriority": 2}))


def _routed(log):
    return route(log, r"(?:sqlserver\.[^.]+|aurora)\.(?:dbo|public|sales)\.(.+)", "$1")


def _tables(docs):
    people = [
        ap.table_view(docs, t, SCHEMAS[t])[0].select(F.lit(t).alias("tbl"), "key", "name", F.col("bal").alias("num"))
        for t in ("customer", "supplier")
    ]
    parts = ap.table_view(docs, "part", SCHEMAS["part"])[0].select(
        F.lit("part").alias("tbl"), "key", "name", F.col("size").cast("double").alias("num"))
    return people[0].unionByName(people[1]).unionByName(parts)


def fanout_state(spark, root):
    """One job applies a log of three tables; each table is then read with its own schema."""
    log = _routed(mixed_log(spark, root))
    return _tables(ap.latest_documents(log.filter(F.col("topic").rlike(r"^(sqlserver|aurora)\.")), deletes="apply"))


def replicate(spark, root):
    """The whole way of a log that is delivered twice and holds updates that were cut off: dedupe,
    route, decode or dead letter, apply. Unreadable updates leave the row as it was."""
    k = F.col("key").cast("bigint")
    log = mixed_log(spark, root).filter(F.col("topic").rlike(r"^(sqlserver|aurora)\."))
    cut = F.when((F.col("op") == "u") & (k % 7 == 0), F.left("value", F.length("value") - 3)).when(
        (F.col("op") == "u") & (k % 11 == 0), F.regexp_replace("value", "-?[0-9.]+}$", '"N/A"}')).otherwise(F.col("value"))
    log = log.withColumn("value", cut)
    once = _routed(ap.dedupe_delivery(log.unionByName(log)))
    good, dead = ap.split_documents(once, SCHEMAS)
    state = _tables(ap.latest_documents(good, deletes="apply")).withColumn("fate", F.lit("applied"))
    letters = dead.select(F.col("target").alias("tbl"), "key", F.lit(None).cast("string").alias("name"),
                          F.lit(None).cast("double").alias("num"), F.lit("dead").alias("fate"))
    return state.unionByName(letters)


def _site_events(spark, root, side):
    """Site a changes even orders, site b odd ones, each on its own topic prefix."""
    log = orders_log(spark, root).filter(F.col("op").isNotNull())
    even = F.col("key.o_orderkey") % 2 == 0
    return log.filter(even if side == "a" else ~even)


def bidirectional_state(spark, root):
    base = ap.as_state(orders(spark, root), lsn=-1)
    a, b = ap.bidirectional(base, base, _site_events(spark, root, "a"), _site_events(spark, root, "b"), KEY, "apply")
    left = ap.live(a).select(F.lit("a").alias("site"), *ORDER_COLS)
    return left.unionByName(ap.live(b).select(F.lit("b").alias("site"), *ORDER_COLS))


def loop_check(spark, root):
    """Reverse events that carry the origin they would return to."""
    forward = tag_origin(select_tables(orders_log(spark, root), include=["dbo.orders"]), "site_b")
    reverse = forward.filter(F.col("op") == "u")
    echoes = find_echoes(forward.filter(F.col("key.o_orderkey") % 6 == 0), reverse, "__origin", "site_a")
    return echoes.select("key.o_orderkey", F.col("source.lsn").alias("lsn"))


def unique_conflicts(spark, root):
    rows = read_table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = ap.unique_conflicts(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


QUERIES = {
    "upsert_drop_deletes": _upsert("drop"),
    "upsert_apply_deletes": _upsert("apply"),
    "upsert_onto_target": onto_target,
    "redelivery_idempotent": redelivery,
    "dedupe_delivery": dedupe,
    "evolve_columns": evolve_columns,
    "fanout_state": fanout_state,
    "replicate": replicate,
    "bidirectional_state": bidirectional_state,
    "loop_check": loop_check,
    "unique_conflicts": unique_conflicts,
}

_COLS = ", ".join(ORDER_COLS[1:])


def _state(where: str, keep: str) -> str:
    return (
        f"SELECT k AS o_orderkey, {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC, offs DESC) AS n "
        f"FROM orders_log WHERE op IS NOT NULL AND {where}) WHERE n = 1 AND {keep}"
    )


_APPLIED = _state("true", "op <> 'd'")
ORACLE = {
    "upsert_drop_deletes": sql(_state("op <> 'd'", "true"), "orders_log"),
    "upsert_apply_deletes": sql(_APPLIED, "orders_log"),
    "upsert_onto_target": sql(_APPLIED, "orders_log"),
    "redelivery_idempotent": sql(_APPLIED, "orders_log"),
    "dedupe_delivery": sql(
        "SELECT partition, op, count(*) AS events FROM (SELECT DISTINCT part AS partition, offs, "
        "coalesce(op, 'tombstone') AS op FROM orders_log) GROUP BY ALL", "orders_log"),
    "evolve_columns": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "fanout_state": sql("""
        SELECT regexp_extract(topic, '[^.]+$') AS tbl, key, name, num FROM (
          SELECT *, row_number() OVER (PARTITION BY topic, key ORDER BY lsn DESC) AS n FROM mixed_log
          WHERE topic LIKE '%.%') WHERE n = 1 AND op <> 'd'""", "mixed_log"),
    "replicate": sql("""
        SELECT tbl, key, name, num, 'applied' AS fate FROM (
          SELECT *, row_number() OVER (PARTITION BY tbl, key ORDER BY lsn DESC) AS n FROM m WHERE NOT bad)
        WHERE n = 1 AND op <> 'd' UNION ALL SELECT tbl, key, NULL, NULL, 'dead' FROM m WHERE bad""", "mixed_log", m="""
        SELECT *, regexp_extract(topic, '[^.]+$') AS tbl, op = 'u' AND (CAST(key AS BIGINT) % 7 = 0 OR CAST(key AS BIGINT) % 11 = 0)
               AS bad FROM mixed_log WHERE topic LIKE '%.%'"""),
    "bidirectional_state": sql(
        "SELECT 'a' AS site, * FROM applied UNION ALL SELECT 'b', * FROM applied", "orders_log", applied=_APPLIED),
    "loop_check": sql(
        "SELECT k AS o_orderkey, lsn FROM orders_log WHERE op = 'u' AND home AND k % 6 = 0", "orders_log"),
    "unique_conflicts": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
          SELECT *, first_value((l_partkey, l_suppkey)) OVER (PARTITION BY l_orderkey, l_linenumber
                 ORDER BY l_partkey, l_suppkey) AS own FROM lineitem) WHERE (l_partkey, l_suppkey) <> own""",
}
