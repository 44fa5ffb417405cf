"""Audit of many databases' catalogs. Every frame carries ``db_id``, so one job covers a fleet.

Catalog frames:

``tables``         db_id, object_id, schema, table, is_system
``change_tables``  db_id, object_id, capture_instance, supports_net_changes, create_date
``keys``           db_id, object_id, type ('PK', 'UQ', ...)
``stats``          db_id, object_id, index_id, row_count
``published``      db_id, publication, schema, table
``constraints``    db_id, schema, table, constraint_type
``live_rows``      db_id, schema, table, n_live
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions.positions import lsn_bytes, size_text
from rowtide.sources.changes import union_all

OBJECT = ["db_id", "object_id"]
NAMED = ["db_id", "schema", "table"]


def _yes(cond: Column) -> Column:
    return F.when(cond, "Yes").otherwise("No")


def heap_rows(stats: DataFrame) -> DataFrame:
    """Rows per table: the heap or clustered index (index 0 or 1), summed over partitions."""
    return stats.filter(F.col("index_id").isin(0, 1)).groupBy(*OBJECT).agg(F.sum("row_count").alias("row_count"))


def primary_keyed(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("type") == "PK").select(*OBJECT).distinct().withColumn("_pk", F.lit(True))


def captured_tables(tables: DataFrame, change_tables: DataFrame, stats: DataFrame, schema: str) -> DataFrame:
    """Tables under capture with instance, net-change flag, enable time and row count."""
    out = change_tables.join(tables.filter(F.col("schema") == schema), OBJECT).join(heap_rows(stats), OBJECT, "left")
    return out.select(
        *NAMED, "capture_instance",
        _yes(F.col("supports_net_changes") == 1).alias("net_changes"),
        F.date_format("create_date", "yyyy-MM-dd HH:mm:ss").alias("enabled_at"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )


def uncaptured_tables(tables: DataFrame, change_tables: DataFrame, keys: DataFrame, stats: DataFrame,
                      schema: str) -> DataFrame:
    """User tables without capture, whether they have a primary key, and their row count."""
    user = tables.filter((F.col("schema") == schema) & ~F.col("is_system"))
    rest = user.join(change_tables.select(*OBJECT), OBJECT, "left_anti")
    out = rest.join(primary_keyed(keys), OBJECT, "left").join(heap_rows(stats), OBJECT, "left")
    return out.select(
        *NAMED, _yes(F.col("_pk").isNotNull()).alias("has_pk"), F.coalesce("row_count", F.lit(0)).alias("row_count")
    )


def _pk_names(constraints: DataFrame) -> DataFrame:
    pk = constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
    return pk.select(*NAMED).distinct().withColumn("_pk", F.lit(True))


def published_tables(published: DataFrame, constraints: DataFrame, live_rows: DataFrame, publication: str,
                     schema: str) -> DataFrame:
    mine = published.filter((F.col("publication") == publication) & (F.col("schema") == schema)).select(*NAMED)
    out = mine.join(_pk_names(constraints), NAMED, "left").join(live_rows, NAMED, "left")
    return out.select(
        *NAMED, _yes(F.col("_pk").isNotNull()).alias("has_pk"), F.coalesce("n_live", F.lit(0)).alias("row_count")
    )


def unpublished_tables(base_tables: DataFrame, published: DataFrame, constraints: DataFrame, live_rows: DataFrame,
                       publication: str, schema: str) -> DataFrame:
    mine = published.filter(F.col("publication") == publication).select(*NAMED)
    rest = base_tables.filter(F.col("schema") == schema).select(*NAMED).join(mine, NAMED, "left_anti")
    out = rest.join(_pk_names(constraints), NAMED, "left").join(live_rows, NAMED, "left")
    return out.select(
        *NAMED, _yes(F.col("_pk").isNotNull()).alias("has_pk"), F.coalesce("n_live", F.lit(0)).alias("row_count")
    )


def no_pk_tables(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """User tables without a primary key; they need key columns named by hand."""
    user = tables.filter(~F.col("is_system"))
    return user.join(primary_keyed(keys), OBJECT, "left_anti").select(*NAMED)


def loop_risk(captured: DataFrame, published: DataFrame) -> DataFrame:
    """Tables that flow both ways: captured on one side and published on the other."""
    name = F.lower(F.trim("table")).alias("table_name")
    a = captured.select("db_id", name).distinct()
    b = published.select("db_id", name).distinct()
    return a.join(b, ["db_id", "table_name"])


def _doubled(name: Column, mark: str) -> Column:
    """A name or text that stands between marks: the mark inside it is doubled."""
    return F.replace(name, F.lit(mark), F.lit(mark * 2))


def remediation(tables: DataFrame, change_tables: DataFrame, keys: DataFrame, schema: str, role: str) -> DataFrame:
    """One idempotent statement per user table without capture. Text only, nothing is executed."""
    todo = (
        tables.filter((F.col("schema") == schema) & ~F.col("is_system"))
        .join(change_tables.select(*OBJECT), OBJECT, "left_anti")
        .join(primary_keyed(keys), OBJECT, "left")
    )
    net = F.when(F.col("_pk").isNotNull(), 1).otherwise(0)
    # Fixed value: form of the statement that switches capture on.
    bracketed = [F.concat(F.lit("["), _doubled(F.col(c), "]"), F.lit("]")) for c in ("schema", "table")]
    text = F.format_string(
        "IF NOT EXISTS (SELECT 1 FROM cdc.change_tables WHERE source_object_id = OBJECT_ID(N'%1$s')) "
        "EXEC sys.sp_cdc_enable_table @source_schema = N'%2$s', @source_name = N'%3$s', "
        "@role_name = N'%4$s', @supports_net_changes = %5$d;",
        *[_doubled(c, "'") for c in (F.concat_ws(".", *bracketed), F.col("schema"), F.col("table"), F.lit(role))], net,
    )
    note = F.when(F.col("_pk").isNull(), "no primary key: name its key columns").otherwise("has primary key")
    return todo.select(*NAMED, net.alias("net_changes"), note.alias("note"), text.alias("statement"))


def publication_remediation(base_tables: DataFrame, published: DataFrame, publication: str, schema: str,
                            role: str) -> DataFrame:
    mine = published.filter(F.col("publication") == publication).select(*NAMED)
    rest = base_tables.filter(F.col("schema") == schema).select(*NAMED).join(mine, NAMED, "left_anti")
    quoted = lambda name: F.concat(F.lit('"'), _doubled(name, '"'), F.lit('"'))
    name = F.concat_ws(".", quoted(F.col("schema")), quoted(F.col("table")))
    add = F.concat(F.lit("ALTER PUBLICATION "), quoted(F.lit(publication)), F.lit(" ADD TABLE "), name, F.lit(";"))
    grant = F.concat(F.lit("GRANT SELECT, INSERT, UPDATE, DELETE ON "), name, F.lit(" TO "), quoted(F.lit(role)), F.lit(";"))
    return rest.select(*NAMED, F.explode(F.array(add, grant)).alias("statement"))


def role_list(members: DataFrame) -> DataFrame:
    """Roles per principal as one sorted, comma-separated text."""
    return (
        members.select("db_id", "principal", "role").distinct()
        .groupBy("db_id", "principal")
        .agg(F.array_join(F.array_sort(F.collect_list("role")), ", ").alias("roles"))
    )


def slot_lag(slots: DataFrame, limit_bytes: int = 1 << 30) -> DataFrame:
    """Bytes a slot still holds back, from ``X/Y`` hex positions, and whether that is too much."""
    lag = lsn_bytes(F.col("current_lsn")) - lsn_bytes(F.col("confirmed_flush_lsn"))
    held = lsn_bytes(F.col("current_lsn")) - lsn_bytes(F.col("restart_lsn"))
    status = F.when(~F.col("active"), "inactive").when(F.col("lag_bytes") > limit_bytes, "over_limit").otherwise("ok")
    return slots.select("db_id", "slot_name", "active", lag.alias("lag_bytes"), held.alias("held_bytes")).select(
        "*", size_text(F.col("lag_bytes")).alias("lag_text"), status.alias("status")
    )


def capture_recency(databases: DataFrame, lsn_time: DataFrame, change_tables: DataFrame, now: Column,
                    hours: int = 24) -> DataFrame:
    """1 if a transaction was mapped in the last day, 0 if tables are captured but none was, else -1."""
    last = lsn_time.groupBy("db_id").agg(F.max("tran_end_time").alias("last_time"))
    has = change_tables.groupBy("db_id").agg(F.count("*").alias("captured"))
    fresh = F.col("last_time") > now - F.make_dt_interval(hours=F.lit(hours))
    state = F.when(fresh, 1).when(F.coalesce("captured", F.lit(0)) > 0, 0).otherwise(-1)
    return databases.select("db_id").distinct().join(last, "db_id", "left").join(has, "db_id", "left").select(
        "db_id", state.alias("recency")
    )


def config_conflicts(config: DataFrame, no_pk_captured: DataFrame) -> DataFrame:
    """Settings that cannot work.

    ``config`` has (db_id, include_list, exclude_list, key_spec); ``no_pk_captured`` the captured
    tables without a primary key (db_id, schema, table). A key spec entry may name a table with
    or without its database.
    """
    def given(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) != ""

    both = config.filter(given("include_list") & given("exclude_list")).select(
        "db_id", F.lit("include_and_exclude").alias("conflict"), F.lit("").alias("subject")
    )
    keyed = config.select("db_id", F.explode(F.split(F.coalesce("key_spec", F.lit("")), ";")).alias("entry"))
    table = F.split_part("entry", F.lit(":"), F.lit(1))
    named = keyed.select("db_id", F.regexp_extract(table, r"([^.\s]+\.[^.\s]+)\s*$", 1).alias("subject"))
    need = no_pk_captured.select("db_id", F.concat_ws(".", "schema", "table").alias("subject"))
    unkeyed = need.join(named.distinct(), ["db_id", "subject"], "left_anti").select(
        "db_id", F.lit("missing_key_columns").alias("conflict"), "subject"
    )
    return both.unionByName(unkeyed)


def check_rows(databases: DataFrame, captured: DataFrame, published: DataFrame, slots: DataFrame,
               recency: DataFrame) -> DataFrame:
    """(db_id, check, status) rows of the readiness audit.

    No captured table, no publication with tables and no slot are failures; a slot that is held
    by another consumer and no recent capture activity are warnings.
    """
    def counted(df: DataFrame, check: str) -> DataFrame:
        n = df.groupBy("db_id").agg(F.count("*").alias("n"))
        status = F.when(F.coalesce("n", F.lit(0)) > 0, "PASS").otherwise("FAIL")
        return databases.select("db_id").distinct().join(n, "db_id", "left").select(
            "db_id", F.lit(check).alias("check"), status.alias("status"))

    active = slots.filter("active").select("db_id").distinct().withColumn("_held", F.lit(True))
    held = slots.select("db_id").distinct().join(active, "db_id", "left").select(
        "db_id", F.lit("slot_free").alias("check"),
        F.when(F.col("_held").isNotNull(), "WARN").otherwise("PASS").alias("status"))
    activity = recency.filter(F.col("recency") >= 0).select(
        "db_id", F.lit("capture_activity").alias("check"),
        F.when(F.col("recency") == 1, "PASS").otherwise("WARN").alias("status"))
    return union_all([
        counted(captured, "captured_tables"), counted(published, "publication_tables"),
        counted(slots, "slot_exists"), held, activity,
    ])


def readiness(checks: DataFrame) -> DataFrame:
    """Totals per database and the overall result."""
    out = checks.groupBy("db_id").agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
    )
    result = F.when(F.col("failures") > 0, "FAILED").when(F.col("warnings") > 0, "PASSED WITH WARNINGS")
    return out.withColumn("result", result.otherwise("ALL CHECKS PASSED"))  # fixed values: texts of the overall result
