"""Catalog audit of a fleet. Every part is a table, a hundred tables make a database; line items
are the storage partitions that hold a table's rows; suppliers give the replication slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import audit as au
from rowtide.plans.logs import sql
from rowtide.sources.tables import read_table

PUBLICATION, ROLE = "cdc_publication", "cdc_reader"


def _db(col, size=100):
    return F.concat(F.lit("db"), F.floor(col / size).cast("string"))


def tables(spark, root):
    p = F.col("p_partkey")
    return read_table(spark, root, "part").select(
        _db(p).alias("db_id"), p.alias("object_id"),
        F.when(p % 10 == 9, "archive").otherwise("dbo").alias("schema"), F.concat(F.lit("t"), p).alias("table"),
        (F.col("p_size") == 1).alias("is_system"))


def change_tables(spark, root):
    p = F.col("p_partkey")
    return read_table(spark, root, "part").filter(p % 3 == 0).select(
        _db(p).alias("db_id"), p.alias("object_id"), F.concat(F.lit("dbo_t"), p).alias("capture_instance"),
        (p % 2).alias("supports_net_changes"),
        (F.lit("2024-01-01 06:30:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("p_size"))).alias("create_date"))


def keys(spark, root):
    p = F.col("p_partkey")
    kinds = F.array_compact(F.array(F.when(p % 7 != 0, "PK"), F.when(p % 5 == 0, "UQ")))
    return read_table(spark, root, "part").select(_db(p).alias("db_id"), p.alias("object_id"), F.explode(kinds).alias("type"))


def stats(spark, root):
    return read_table(spark, root, "lineitem").select(
        _db(F.col("l_partkey")).alias("db_id"), F.col("l_partkey").alias("object_id"),
        (F.col("l_linenumber") % 3).alias("index_id"), F.col("l_quantity").cast("bigint").alias("row_count"))


def published(spark, root):
    p = F.col("p_partkey")
    return read_table(spark, root, "part").filter(p % 4 < 2).select(
        _db(p).alias("db_id"), F.when(p % 8 < 4, PUBLICATION).otherwise("other").alias("publication"),
        F.lit("public").alias("schema"), F.concat(F.lit("T"), p).alias("table"))


def base_tables(spark, root):
    p = F.col("p_partkey")
    return read_table(spark, root, "part").select(
        _db(p).alias("db_id"), F.lit("public").alias("schema"), F.concat(F.lit("T"), p).alias("table"))


def constraints(spark, root):
    p = F.col("p_partkey")
    return read_table(spark, root, "part").select(
        _db(p).alias("db_id"), F.lit("public").alias("schema"), F.concat(F.lit("T"), p).alias("table"),
        F.when(p % 7 != 0, "PRIMARY KEY").otherwise("UNIQUE").alias("constraint_type"))


def live_rows(spark, root):
    return read_table(spark, root, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_live")).filter(
        F.col("l_partkey") % 9 != 0).select(
        _db(F.col("l_partkey")).alias("db_id"), F.lit("public").alias("schema"),
        F.concat(F.lit("T"), F.col("l_partkey")).alias("table"), "n_live")


def slots(spark, root):
    s = F.col("s_suppkey")

    def pos(hi, lo):
        return F.concat_ws("/", F.hex(hi), F.hex(lo))

    return read_table(spark, root, "supplier").select(
        _db(s, 5).alias("db_id"), F.concat(F.lit("slot_"), s).alias("slot_name"), (s % 6 != 0).alias("active"),
        pos(s, s * 4097).alias("restart_lsn"), pos(s, s * 8191).alias("confirmed_flush_lsn"),
        pos(s + F.when(s % 9 == 0, 1).otherwise(0), s * 16381).alias("current_lsn"))


def lsn_time(spark, root):
    ev = read_table(spark, root, "events")
    busy = F.floor(F.col("user_id") / 8) % 4 != 1
    return ev.filter((F.col("event_type") != "signup") & busy).select(
        _db(F.col("user_id"), 8).alias("db_id"), F.col("event_id").alias("lsn"),
        F.col("ts").alias("tran_end_time"))


NOW = "2024-01-30 12:00:00"


def recency(spark, root):
    now = F.lit(NOW).cast("timestamp_ntz")
    before = lsn_time(spark, root).filter(F.col("tran_end_time") <= now)
    captured = change_tables(spark, root).filter(F.col("db_id") != "db1")
    return au.capture_recency(tables(spark, root), before, captured, now)


def members(spark, root):
    return read_table(spark, root, "customer").select(
        _db(F.col("c_custkey"), 75).alias("db_id"), F.concat(F.lit("user"), F.col("c_nationkey")).alias("principal"),
        F.lower("c_mktsegment").alias("role"))


def config(spark, root):
    """One row of settings per database, which has a hundred tables at most; key columns are named
    for some tables only."""
    p = F.col("p_partkey")
    entry = F.concat(F.lit("shop.dbo.t"), p, F.lit(":a,b"))
    spec = F.array_join(F.array_sort(F.collect_list(F.when(p % 2 == 0, entry))), ";")
    return read_table(spark, root, "part").filter(p % 21 == 0).groupBy(_db(p).alias("db_id")).agg(
        F.max(F.when(p % 4 == 0, "dbo.a,dbo.b")).alias("include_list"),
        F.max(F.when(p % 6 == 0, "dbo.c")).alias("exclude_list"), spec.alias("key_spec"))


def captured(spark, root):
    return au.captured_tables(tables(spark, root), change_tables(spark, root), stats(spark, root), "dbo")


def uncaptured(spark, root):
    return au.uncaptured_tables(
        tables(spark, root), change_tables(spark, root), keys(spark, root), stats(spark, root), "dbo")


def published_query(spark, root):
    return au.published_tables(
        published(spark, root), constraints(spark, root), live_rows(spark, root), PUBLICATION, "public")


def unpublished(spark, root):
    return au.unpublished_tables(
        base_tables(spark, root), published(spark, root), constraints(spark, root), live_rows(spark, root), PUBLICATION,
        "public")


def no_pk(spark, root):
    return au.no_pk_tables(tables(spark, root), keys(spark, root))


def loop_risk(spark, root):
    mine = published(spark, root).filter(F.col("publication") == PUBLICATION)
    return au.loop_risk(captured(spark, root), mine)


def _odd_names(df):
    """Every tenth table has a name that has to be quoted."""
    odd = F.concat(F.lit("O'"), "table", F.lit('"]'))
    return df.withColumn("table", F.when(F.col("table").endswith("5"), odd).otherwise(F.col("table")))


def remediation(spark, root):
    return au.remediation(_odd_names(tables(spark, root)), change_tables(spark, root), keys(spark, root), "dbo", ROLE)


def publication_remediation(spark, root):
    base, have = _odd_names(base_tables(spark, root)), _odd_names(published(spark, root))
    return au.publication_remediation(base, have, PUBLICATION, "public", ROLE)


def role_list(spark, root):
    return au.role_list(members(spark, root))


def slot_lag(spark, root):
    return au.slot_lag(slots(spark, root))


def config_conflicts(spark, root):
    kept = change_tables(spark, root).select("db_id", "object_id")
    bare = au.no_pk_tables(tables(spark, root).join(kept, ["db_id", "object_id"], "left_semi"), keys(spark, root))
    return au.config_conflicts(config(spark, root), bare)


def checks(spark, root):
    mine = published(spark, root).filter((F.col("publication") == PUBLICATION) & (F.col("db_id") != "db4"))
    return au.check_rows(tables(spark, root), captured(spark, root), mine, slots(spark, root), recency(spark, root))


def readiness(spark, root):
    return au.readiness(checks(spark, root))


QUERIES = {
    "captured_tables": captured,
    "uncaptured_tables": uncaptured,
    "published_tables": published_query,
    "unpublished_tables": unpublished,
    "no_pk_tables": no_pk,
    "loop_risk": loop_risk,
    "remediation": remediation,
    "publication_remediation": publication_remediation,
    "role_list": role_list,
    "readiness_checks": checks,
    "readiness": readiness,
    "slot_lag": slot_lag,
    "capture_recency": recency,
    "config_conflicts": config_conflicts,
}

_ROWS = "(SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY 1)"
_LIVE = "(SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1)"
_T = (
    "SELECT *, 'db' || p_partkey // 100 AS db_id, CASE WHEN p_partkey % 10 = 9 THEN 'archive' ELSE 'dbo' END AS schema, "
    "'t' || p_partkey AS tbl, p_partkey % 7 <> 0 AS pk FROM part"
)
_TODO = "p_partkey % 3 <> 0 AND p_size <> 1 AND schema = 'dbo'"
_RECENCY = f"""
    SELECT db_id, CASE WHEN last > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 1 WHEN n > 0 THEN 0 ELSE -1 END AS recency
    FROM (SELECT DISTINCT db_id FROM t) LEFT JOIN
      (SELECT 'db' || user_id // 8 AS db_id, max(ts) AS last FROM events
       WHERE event_type <> 'signup' AND user_id // 8 % 4 <> 1 AND ts <= TIMESTAMP '{NOW}' GROUP BY 1) USING (db_id) LEFT JOIN
      (SELECT db_id, count(*) AS n FROM t WHERE p_partkey % 3 = 0 AND db_id <> 'db1' GROUP BY 1) USING (db_id)"""
_CHECKS = """
    SELECT db_id, 'captured_tables' AS "check", CASE WHEN count(*) FILTER (WHERE p_partkey % 3 = 0 AND schema = 'dbo') > 0
           THEN 'PASS' ELSE 'FAIL' END AS status FROM t GROUP BY db_id
    UNION ALL SELECT db_id, 'publication_tables', CASE WHEN count(*) FILTER (WHERE p_partkey % 4 < 2 AND p_partkey % 8 < 4
           AND db_id <> 'db4') > 0 THEN 'PASS' ELSE 'FAIL' END FROM t GROUP BY db_id
    UNION ALL SELECT db_id, 'slot_exists', CASE WHEN db_id IN (SELECT 'db' || s_suppkey // 5 FROM supplier) THEN 'PASS'
           ELSE 'FAIL' END FROM t GROUP BY db_id
    UNION ALL SELECT 'db' || s_suppkey // 5 AS db_id, 'slot_free', CASE WHEN bool_or(s_suppkey % 6 <> 0) THEN 'WARN'
           ELSE 'PASS' END FROM supplier GROUP BY 1
    UNION ALL SELECT db_id, 'capture_activity', CASE recency WHEN 1 THEN 'PASS' ELSE 'WARN' END FROM rec WHERE recency >= 0"""

ORACLE = {
    "captured_tables": sql(f"""
        SELECT db_id, schema, tbl AS "table", 'dbo_t' || p_partkey AS capture_instance,
               CASE WHEN p_partkey % 2 = 1 THEN 'Yes' ELSE 'No' END AS net_changes,
               strftime(TIMESTAMP '2024-01-01 06:30:00' + to_days(p_size), '%Y-%m-%d %H:%M:%S') AS enabled_at,
               coalesce(n, 0) AS row_count
        FROM t LEFT JOIN {_ROWS} r ON l_partkey = p_partkey WHERE p_partkey % 3 = 0 AND schema = 'dbo'""", t=_T),
    "uncaptured_tables": sql(f"""
        SELECT db_id, schema, tbl AS "table", CASE WHEN pk THEN 'Yes' ELSE 'No' END AS has_pk, coalesce(n, 0) AS row_count
        FROM t LEFT JOIN {_ROWS} r ON l_partkey = p_partkey WHERE {_TODO}""", t=_T),
    "published_tables": sql(f"""
        SELECT db_id, 'public' AS schema, 'T' || p_partkey AS "table", CASE WHEN pk THEN 'Yes' ELSE 'No' END AS has_pk,
               coalesce(n, 0) AS row_count FROM t LEFT JOIN {_LIVE} r ON l_partkey = p_partkey
        WHERE p_partkey % 4 < 2 AND p_partkey % 8 < 4""", t=_T),
    "unpublished_tables": sql(f"""
        SELECT db_id, 'public' AS schema, 'T' || p_partkey AS "table", CASE WHEN pk THEN 'Yes' ELSE 'No' END AS has_pk,
               coalesce(n, 0) AS row_count FROM t LEFT JOIN {_LIVE} r ON l_partkey = p_partkey
        WHERE NOT (p_partkey % 4 < 2 AND p_partkey % 8 < 4)""", t=_T),
    "no_pk_tables": sql('SELECT db_id, schema, tbl AS "table" FROM t WHERE NOT pk AND p_size <> 1', t=_T),
    "loop_risk": sql("""
        SELECT db_id, tbl AS table_name FROM t
        WHERE p_partkey % 3 = 0 AND schema = 'dbo' AND p_partkey % 4 < 2 AND p_partkey % 8 < 4""", t=_T),
    "remediation": sql(f"""
        SELECT db_id, schema, CASE WHEN p_partkey % 10 = 5 THEN 'O''' || tbl || '"]' ELSE tbl END AS "table",
               CAST(pk AS INTEGER) AS net_changes,
               CASE WHEN pk THEN 'has primary key' ELSE 'no primary key: name its key columns' END AS note,
               'IF NOT EXISTS (SELECT 1 FROM cdc.change_tables WHERE source_object_id = OBJECT_ID(N''[dbo].[' ||
               CASE WHEN p_partkey % 10 = 5 THEN 'O''''' || tbl || '"]]' ELSE tbl END ||
               ']'')) EXEC sys.sp_cdc_enable_table @source_schema = N''dbo'', @source_name = N''' ||
               CASE WHEN p_partkey % 10 = 5 THEN 'O''''' || tbl || '"]' ELSE tbl END ||
               ''', @role_name = N''cdc_reader'', @supports_net_changes = ' || CAST(pk AS INTEGER) || ';' AS statement
        FROM t WHERE {_TODO}""", t=_T),
    "publication_remediation": sql("""
        SELECT db_id, 'public' AS schema, CASE WHEN p_partkey % 10 = 5 THEN 'O''T' || p_partkey || '"]' ELSE 'T' || p_partkey END
               AS "table", unnest([
               'ALTER PUBLICATION "cdc_publication" ADD TABLE "public"."' || quoted || '";',
               'GRANT SELECT, INSERT, UPDATE, DELETE ON "public"."' || quoted || '" TO "cdc_reader";']) AS statement
        FROM (SELECT *, CASE WHEN p_partkey % 10 = 5 THEN 'O''T' || p_partkey || '""]' ELSE 'T' || p_partkey END AS quoted FROM t)
        WHERE NOT (p_partkey % 4 < 2 AND p_partkey % 8 < 4)""", t=_T),
    "role_list": """
        SELECT db_id, principal, string_agg(role, ', ' ORDER BY role) AS roles FROM (
          SELECT DISTINCT 'db' || c_custkey // 75 AS db_id, 'user' || c_nationkey AS principal, lower(c_mktsegment) AS role
          FROM customer) GROUP BY ALL""",
    "readiness_checks": sql(_CHECKS, t=_T, rec=_RECENCY),
    "readiness": sql("""
        SELECT db_id, passed, warnings, failures, CASE WHEN failures > 0 THEN 'FAILED' WHEN warnings > 0
               THEN 'PASSED WITH WARNINGS' ELSE 'ALL CHECKS PASSED' END AS result
        FROM (SELECT db_id, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warnings,
                     count(*) FILTER (WHERE status = 'FAIL') AS failures FROM checks GROUP BY db_id)""",
                     t=_T, rec=_RECENCY, checks=_CHECKS),
    "slot_lag": """
        SELECT db_id, slot_name, active, lag_bytes, held_bytes,
               CASE WHEN lag_bytes < 1024 THEN lag_bytes || ' bytes' WHEN lag_bytes < 1048576 THEN lag_bytes // 1024 || ' kB'
                    WHEN lag_bytes < 1073741824 THEN lag_bytes // 1048576 || ' MB' ELSE lag_bytes // 1073741824 || ' GB' END AS lag_text,
               CASE WHEN NOT active THEN 'inactive' WHEN lag_bytes > 1073741824 THEN 'over_limit' ELSE 'ok' END AS status
        FROM (SELECT 'db' || s_suppkey // 5 AS db_id, 'slot_' || s_suppkey AS slot_name, s_suppkey % 6 <> 0 AS active,
                     up + s_suppkey * (16381 - 8191) AS lag_bytes, up + s_suppkey * (16381 - 4097) AS held_bytes
              FROM (SELECT *, CASE WHEN s_suppkey % 9 = 0 THEN 4294967296 ELSE 0 END AS up FROM supplier))""",
    "capture_recency": sql(_RECENCY, t=_T),
    "config_conflicts": sql("""
        SELECT db_id, 'include_and_exclude' AS conflict, '' AS subject FROM t WHERE p_partkey % 21 = 0 GROUP BY db_id
        HAVING bool_or(p_partkey % 4 = 0) AND bool_or(p_partkey % 6 = 0)
        UNION ALL SELECT db_id, 'missing_key_columns', schema || '.' || tbl FROM t
        WHERE p_partkey % 21 = 0 AND p_size <> 1 AND NOT (p_partkey % 2 = 0 AND schema = 'dbo')""", t=_T),
}
