"""Source against target: counts, keys, values, references, schemas, propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import digests as dg
from rowtide.operators import ranges as rg
from rowtide.operators import reconcile as rc
from rowtide.operators import sketches as sk
from rowtide.plans.logs import NEW_KEY, orders, sql
from rowtide.sources.tables import read_table


#: Last second of the applied logs that is looked at.
UNTIL = 20_000


def target_orders(spark, root):
    """The other site: some orders are missing, some differ, some are extra."""
    src = orders(spark, root)
    k = F.col("o_orderkey")
    kept = src.filter(k % 17 != 0).withColumn(
        "o_orderstatus", F.when(k % 19 == 0, "X").otherwise(F.col("o_orderstatus")))
    return kept.unionByName(src.filter(k % 23 == 0).withColumn("o_orderkey", k + NEW_KEY))


def count_parity(spark, root):
    cust = read_table(spark, root, "customer")
    lines = read_table(spark, root, "lineitem")
    return rc.count_parity([
        ("orders", orders(spark, root), target_orders(spark, root), ["o_orderkey"]),
        ("customer", cust, cust, ["c_custkey"]),
        ("lineitem", lines, lines.filter(F.col("l_quantity") > 1), ["l_orderkey", "l_linenumber"]),
    ])


def duplicate_keys(spark, root):
    return rc.duplicate_keys(read_table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"])


def missing_extra(spark, root):
    return rc.missing_extra(orders(spark, root), target_orders(spark, root), ["o_orderkey"])


def value_diff(spark, root):
    return rc.value_diff(orders(spark, root), target_orders(spark, root), ["o_orderkey"])


def differing_rows(spark, root):
    out = rc.differing_rows(orders(spark, root), target_orders(spark, root), ["o_orderkey"])
    return out.select("o_orderkey", F.array_join("columns", ",").alias("columns"))


def bucket_checksum(spark, root):
    """Sixteen buckets per side; the digests must differ just where rows differ."""
    src = orders(spark, root)
    same = rc.checksum_diff(src, src.repartition(5), ["o_orderkey"], 16)
    other = rc.checksum_diff(src, target_orders(spark, root), ["o_orderkey"], 16)
    both = same.select(F.lit("same").alias("pair"), "*").unionByName(other.select(F.lit("changed").alias("pair"), "*"))
    return both.groupBy("pair").agg(
        F.count("*").alias("buckets"), F.count_if("equal").alias("equal_buckets"),
        F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))


def fk_orphans(spark, root):
    parent = orders(spark, root).filter(F.col("o_orderkey") % 13 != 0)
    out = rc.fk_orphans(read_table(spark, root, "lineitem"), parent, "l_orderkey", "o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


def null_violations(spark, root):
    k = F.col("o_orderkey")
    df = orders(spark, root).select(
        F.when(k % 101 != 0, k).alias("o_orderkey"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_custkey")
    return rc.null_violations(df, ["o_orderkey", "o_orderstatus", "o_custkey"])


# one catalog row per (table, column); three columns per supplier's table
_COLS = [("id", "bigint"), ("name", "string"), ("amount", "decimal(12,2)")]


def column_catalogs(spark, root):
    """Column lists of two sites, a table per supplier, with differences by rule."""
    s = read_table(spark, root, "supplier").select(F.col("s_suppkey").alias("t"))
    cols = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(ty).alias("type"), F.lit(n != "id").alias("nullable"))
                     for n, ty in _COLS])
    a = s.select("t", F.concat(F.lit("t"), "t").alias("table"), F.inline(cols))
    name = F.col("column")
    b = a.filter(~((F.col("t") % 7 == 0) & (name == "amount"))).withColumns({
        "type": F.when((F.col("t") % 5 == 0) & (name == "amount"), "double").otherwise(F.col("type")),
        "nullable": F.when((F.col("t") % 3 == 0) & (name == "name"), False).otherwise(F.col("nullable")),
    })
    extra = s.filter(F.col("t") % 11 == 0).select(
        "t", F.concat(F.lit("t"), "t").alias("table"), F.lit("note").alias("column"), F.lit("string").alias("type"),
        F.lit(True).alias("nullable"))
    return a.drop("t"), b.unionByName(extra).drop("t")


def schema_parity(spark, root):
    a, b = column_catalogs(spark, root)
    return rc.schema_parity(a, b, ["table", "column"])


def schema_registry(spark, root):
    """Two versions of a schema per supplier; the second changes by rule."""
    s = read_table(spark, root, "supplier").select(F.col("s_suppkey").alias("t"))
    subject = F.concat(F.lit("sqlserver.shop.dbo.t"), "t", F.lit("-value")).alias("subject")

    def field(name, type_, nullable=False, default=False):
        return F.struct(F.lit(name).alias("name"), F.lit(type_).alias("type"), F.lit(nullable).alias("nullable"),
                        F.lit(default).alias("has_default"))

    kind = F.col("t") % 6
    v1 = F.array(field("id", "int"), field("name", "string"), field("bal", "double", True))
    v2 = F.array_compact(F.array(
        F.when(kind == 3, field("id", "bigint")).otherwise(field("id", "int")),
        F.when(kind == 4, field("name", "int")).otherwise(field("name", "string")),
        F.when(kind != 2, field("bal", "double", True)),
        F.when(kind == 0, field("note", "string", True)),
        F.when(kind == 1, field("code", "string")),
    ))
    one = s.select(subject, F.lit(1).alias("version"), F.inline(v1))
    return one.unionByName(s.select(subject, F.lit(2).alias("version"), F.inline(v2)))


def schema_compat(spark, root):
    return rc.schema_compat(schema_registry(spark, root)).filter(F.col("version") == 2)


def compat_summary(spark, root):
    return rc.compat_summary(schema_registry(spark, root))


def tree_diff(spark, root):
    """A target in which a few orders are missing, changed, extra, or have a value in a new column."""
    src, k = orders(spark, root), F.col("o_orderkey")
    tgt = src.where(k % 5000 != 7).withColumn("o_orderstatus", F.when(k % 7000 == 3, "X").otherwise(F.col("o_orderstatus")))
    tgt = tgt.withColumn("note", F.when(k % 9000 == 4, "n"))
    extra = src.where(k % 8000 == 5).withColumns({"o_orderkey": k + NEW_KEY, "note": F.lit(None).cast("string")})
    out = dg.tree_diff(src, tgt.unionByName(extra), ["o_orderkey"], 6)
    return out.select("o_orderkey", "status", F.array_join("columns", ",").alias("columns"))


def _applied(spark, root):
    """Change logs of lines and orders as a target applied them: lines from second (key % 89) on, orders
    from minute (key % 97) on; some orders never came, went, or came back; some lines went."""
    o, line = read_table(spark, root, "orders"), read_table(spark, root, "lineitem")
    k = F.col("o_orderkey")
    first = (k % 97) * 60

    def change(at, gone, seq):
        return F.struct(at.cast("bigint").alias("at"), F.lit(gone).alias("gone"), F.lit(seq).alias("seq"))

    parent = o.where(k % 13 != 0).select(k.alias("ref"), F.inline(F.array_compact(F.array(
        change(first, False, 0), F.when(k % 10 == 0, change(first + 3600, True, 1)), F.when(k % 20 == 0, change(first + 5400, False, 2))))))
    lk, n = F.col("l_orderkey"), F.col("l_linenumber")
    born = (lk % 89) * 60 + n
    child = line.select("l_orderkey", "l_linenumber", lk.alias("ref"), F.inline(F.array_compact(F.array(
        change(born, False, 0), F.when(n % 2 == 0, change(born + 60, False, 1)), F.when((lk + n) % 7 == 0, change(born + 1800, True, 2))))))
    return child, parent


def fk_violation_intervals(spark, root):
    child, parent = _applied(spark, root)
    return rc.fk_violation_intervals(child, parent, ["l_orderkey", "l_linenumber"], UNTIL, 1000)


def _delivered(spark, root):
    """Offsets of a log of events: every 50th was lost, every third of the first half came twice."""
    e = F.col("event_id")
    ev = read_table(spark, root, "events").where(e % 50 != 9)
    return ev.select(F.lit("p.db.dbo.events").alias("topic"), (e % 4).cast("int").alias("partition"), F.floor(e / 4).cast("bigint").alias("offset"), "event_id")


def offset_gaps(spark, root):
    """Offsets that never came, from those that did; deliveries that came twice change nothing."""
    ev = _delivered(spark, root)
    return rg.offset_gaps(rg.offset_ranges(ev.unionByName(ev.where(F.col("event_id") % 3 == 0)), 512), chunk=512)


def dedupe_by_ranges(spark, root):
    """A second delivery of everything, in which only what the first one lacked is new."""
    ev = _delivered(spark, root)
    first = rg.offset_ranges(ev.where(F.col("offset") % 11 != 0), 512)
    again = ev.unionByName(ev.where(F.col("event_id") % 3 == 0))
    return rg.dedupe_by_ranges(again, rg.merge_ranges(first, first), 512).select("partition", "offset", "event_id")


def key_overlap(spark, root):
    """Keys in common estimated from one sketch a side, and whether each figure is within the stated error."""
    src, tgt = orders(spark, root), target_orders(spark, root)
    told = sk.key_overlap(sk.key_sketch(src, ["o_orderkey"]), sk.key_sketch(tgt, ["o_orderkey"]))
    k = F.col("o_orderkey")
    exact = src.agg(F.count("*").alias("s"), F.count_if(k % 17 == 0).alias("gone"), F.count_if(k % 23 == 0).alias("more"))
    bound = sk.THETA_ERROR * (F.col("s") + F.col("more"))
    true = {"source_keys": F.col("s"), "target_keys": F.col("s") - F.col("gone") + F.col("more"), "common": F.col("s") - F.col("gone"), "missing": F.col("gone"), "extra": F.col("more")}
    one = told.unionByName(exact, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in [*told.columns, *exact.columns]])  # of two rows
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), x.cast("bigint").alias("exact"), (F.abs(F.col(n) - x) <= bound).alias("within")) for n, x in true.items()])))


def propagation(spark, root):
    """Orders with status 'F' are the markers; arrival takes 0 to 39 s, one in seven is lost."""
    k = F.col("o_orderkey")
    src = orders(spark, root)
    tgt = src.filter(k % 7 != 0).withColumn("seen", F.col("o_orderdate") + F.make_dt_interval(secs=k % 40))
    return rc.propagation(src, tgt, "o_orderkey", "o_orderstatus", "F", 100, 15, "o_orderdate", "seen")


def snapshot_progress(spark, root):
    """Rows per customer on both sides; a table is a customer, a connector its nation."""
    tgt = target_orders(spark, root)
    src_n = orders(spark, root).groupBy("o_custkey").agg(F.count("*").alias("source_rows"))
    tgt_n = tgt.filter(F.col("o_orderkey") < NEW_KEY).groupBy("o_custkey").agg(F.count("*").alias("target_rows"))
    cust = read_table(spark, root, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey")).alias("connector"), F.col("c_custkey").alias("o_custkey"))
    progress = cust.join(src_n, "o_custkey").join(tgt_n, "o_custkey", "left").withColumn(
        "target_rows", F.coalesce("target_rows", F.lit(0)))
    return rc.snapshot_progress(progress.withColumnRenamed("o_custkey", "table"))


QUERIES = {
    "count_parity": count_parity,
    "duplicate_keys": duplicate_keys,
    "missing_extra": missing_extra,
    "value_diff": value_diff,
    "differing_rows": differing_rows,
    "bucket_checksum": bucket_checksum,
    "fk_orphans": fk_orphans,
    "null_violations": null_violations,
    "schema_parity": schema_parity,
    "schema_compat": schema_compat,
    "compat_summary": compat_summary,
    "tree_diff": tree_diff,
    "fk_violation_intervals": fk_violation_intervals,
    "offset_gaps": offset_gaps,
    "dedupe_by_ranges": dedupe_by_ranges,
    "key_overlap": key_overlap,
    "propagation": propagation,
    "snapshot_progress": snapshot_progress,
}

_TARGET = f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0
    UNION ALL SELECT o_orderkey + {NEW_KEY}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 23 = 0"""


def _parity(name: str, src: str, tgt: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS \"table\", s.n AS source_rows, t.n AS target_rows, s.k AS source_keys, t.k AS target_keys, "
        "CASE WHEN s.n = t.n AND s.k = t.k THEN 'PASS' ELSE 'FAIL' END AS status FROM "
        f"(SELECT count(*) AS n, count(DISTINCT {key}) AS k FROM {src}) s, "
        f"(SELECT count(*) AS n, count(DISTINCT {key}) AS k FROM {tgt}) t"
    )


def _diffs() -> str:
    cols = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS compared, count(*) FILTER (WHERE s.{c} IS DISTINCT FROM t.{c}) AS mismatches "
        "FROM orders s JOIN target t USING (o_orderkey)" for c in cols)


_CATALOG_A = (
    "SELECT s_suppkey AS t, 't' || s_suppkey AS \"table\", c.* FROM supplier, (VALUES ('id', 'bigint', false), "
    "('name', 'string', true), ('amount', 'decimal(12,2)', true)) AS c(\"column\", type, nullable)"
)
_CATALOG_B = """
    SELECT t, "table", "column", CASE WHEN t % 5 = 0 AND "column" = 'amount' THEN 'double' ELSE type END AS type,
           CASE WHEN t % 3 = 0 AND "column" = 'name' THEN false ELSE nullable END AS nullable
    FROM a WHERE NOT (t % 7 = 0 AND "column" = 'amount')
    UNION ALL SELECT s_suppkey, 't' || s_suppkey, 'note', 'string', true FROM supplier WHERE s_suppkey % 11 = 0"""

_COMPAT = """
    SELECT 'sqlserver.shop.dbo.t' || t || '-value' AS subject, CAST(2 AS INTEGER) AS version, name,
           CASE name WHEN 'id' THEN CASE WHEN t % 6 = 3 THEN 'widened' ELSE 'unchanged' END
                WHEN 'name' THEN CASE WHEN t % 6 = 4 THEN 'type_changed' ELSE 'unchanged' END
                WHEN 'bal' THEN CASE WHEN t % 6 = 2 THEN 'removed' ELSE 'unchanged' END
                WHEN 'note' THEN 'added_optional' WHEN 'code' THEN 'added_required' END AS verdict
    FROM (SELECT s_suppkey AS t, name FROM supplier, (VALUES ('id'), ('name'), ('bal'), ('note'), ('code')) AS n(name))
    WHERE name IN ('id', 'name', 'bal') OR (name = 'note' AND t % 6 = 0) OR (name = 'code' AND t % 6 = 1)"""

ORACLE = {
    "count_parity": sql(" UNION ALL ".join([
        _parity("orders", "orders", "target", "o_orderkey"),
        _parity("customer", "customer", "customer", "c_custkey"),
        _parity("lineitem", "lineitem", "(SELECT * FROM lineitem WHERE l_quantity > 1)", "(l_orderkey, l_linenumber)"),
    ]), target=_TARGET),
    "duplicate_keys": (
        "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "missing_extra": sql("""
        SELECT o_orderkey, 'missing' AS status FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)
        UNION ALL SELECT o_orderkey, 'extra' FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
                         target=_TARGET),
    "value_diff": sql(_diffs(), target=_TARGET),
    "differing_rows": sql("""
        SELECT o_orderkey, 'o_orderstatus' AS columns FROM orders s JOIN target t USING (o_orderkey)
        WHERE s.o_orderstatus IS DISTINCT FROM t.o_orderstatus""", target=_TARGET),
    "bucket_checksum": sql("""
        SELECT 'same' AS pair, CAST(16 AS BIGINT) AS buckets, CAST(16 AS BIGINT) AS equal_buckets, count(*) AS source_rows,
               count(*) AS target_rows FROM orders
        UNION ALL SELECT 'changed', 16, 0, (SELECT count(*) FROM orders), (SELECT count(*) FROM target)""",
                           target=_TARGET),
    "fk_orphans": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 13 = 0",
    "null_violations": """
        SELECT 'o_orderkey' AS "column", count(*) AS "rows", count(*) FILTER (WHERE o_orderkey % 101 = 0) AS nulls,
               'FAIL' AS status FROM orders
        UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (WHERE o_orderkey % 7 = 0 OR o_orderstatus IS NULL),
               'FAIL' FROM orders
        UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (WHERE o_custkey IS NULL), 'PASS' FROM orders""",
    "schema_parity": sql("""
        SELECT "table", "column", a.type AS type_a, b.type AS type_b, a.nullable AS null_a, b.nullable AS null_b,
               CASE WHEN b.type IS NULL THEN 'missing_in_target' WHEN a.type IS NULL THEN 'extra_in_target'
                    WHEN a.type <> b.type THEN 'type_differs' WHEN a.nullable <> b.nullable THEN 'nullability_differs'
                    ELSE 'equal' END AS verdict
        FROM a FULL JOIN b USING ("table", "column")""", a=_CATALOG_A, b=_CATALOG_B),
    "schema_compat": sql(
        "SELECT *, verdict NOT IN ('added_required', 'type_changed') AS compatible FROM compat", compat=_COMPAT),
    "compat_summary": """
        SELECT 'sqlserver.shop.dbo.t' || s_suppkey || '-value' AS subject, CAST(2 AS INTEGER) AS version,
               s_suppkey % 6 NOT IN (1, 4) AS compatible,
               CASE s_suppkey % 6 WHEN 0 THEN 'none, the sink adds the column' WHEN 1 THEN 'give the column a default'
                    WHEN 2 THEN 'relax the subject''s level until the change is through'
                    WHEN 4 THEN 'flush the topic and recreate the connector' ELSE 'none' END AS remedy FROM supplier""",
    "tree_diff": f"""
        SELECT o_orderkey, 'missing' AS status, NULL AS columns FROM orders WHERE o_orderkey % 5000 = 7
        UNION ALL SELECT o_orderkey, 'changed', concat_ws(',', CASE WHEN o_orderkey % 7000 = 3 AND o_orderstatus IS DISTINCT FROM 'X'
          THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 9000 = 4 THEN 'note' END) FROM orders
          WHERE o_orderkey % 5000 <> 7 AND ((o_orderkey % 7000 = 3 AND o_orderstatus IS DISTINCT FROM 'X') OR o_orderkey % 9000 = 4)
        UNION ALL SELECT o_orderkey + {NEW_KEY}, 'extra', NULL FROM orders WHERE o_orderkey % 8000 = 5""",
    "fk_violation_intervals": f"""
        WITH p AS (SELECT o_orderkey AS k, o_orderkey % 97 * 60 AS a FROM orders),
        bare AS (
          SELECT k, 0 AS s, {UNTIL} + 1 AS e FROM p WHERE k % 13 = 0
          UNION ALL SELECT k, 0, a FROM p WHERE k % 13 <> 0
          UNION ALL SELECT k, a + 3600, CASE WHEN k % 20 = 0 THEN a + 5400 ELSE {UNTIL} + 1 END FROM p WHERE k % 13 <> 0 AND k % 10 = 0
        ), c AS (
          SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey % 89 * 60 + l_linenumber AS s,
            CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN l_orderkey % 89 * 60 + l_linenumber + 1800 ELSE {UNTIL} + 1 END AS e FROM lineitem
        )
        SELECT l_orderkey, l_linenumber, l_orderkey AS ref, CAST(greatest(c.s, b.s) AS BIGINT) AS since,
          CAST(CASE WHEN least(c.e, b.e) <= {UNTIL} THEN least(c.e, b.e) END AS BIGINT) AS till,
          CASE WHEN least(c.e, b.e) > {UNTIL} THEN 'open' WHEN least(c.e, b.e) = c.e THEN 'withdrawn' ELSE 'healed' END AS state
        FROM c JOIN bare b ON b.k = c.l_orderkey AND c.s < b.e AND b.s < c.e""",
    "offset_gaps": """
        WITH o AS (SELECT CAST(event_id % 4 AS INTEGER) AS p, CAST(event_id // 4 AS BIGINT) AS o FROM events WHERE event_id % 50 <> 9),
        n AS (SELECT p, o, lead(o) OVER (PARTITION BY p ORDER BY o) AS x FROM (SELECT DISTINCT p, o FROM o))
        SELECT 'p.db.dbo.events' AS topic, p AS "partition", o + 1 AS start, x - 1 AS "end", x - o - 1 AS lost FROM n WHERE x > o + 1""",
    "dedupe_by_ranges": """
        SELECT CAST(event_id % 4 AS INTEGER) AS "partition", CAST(event_id // 4 AS BIGINT) AS "offset", event_id FROM events
        WHERE event_id % 50 <> 9 AND event_id // 4 % 11 = 0""",
    "key_overlap": """
        SELECT unnest(['source_keys', 'target_keys', 'common', 'missing', 'extra']) AS figure,
               unnest([s, s - gone + more, s - gone, gone, more]) AS exact, true AS within
        FROM (SELECT count(*) AS s, count(*) FILTER (WHERE o_orderkey % 17 = 0) AS gone,
                     count(*) FILTER (WHERE o_orderkey % 23 = 0) AS more FROM orders)""",
    "propagation": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS delay_s,
               CASE WHEN o_orderkey % 7 = 0 THEN 'lost' WHEN o_orderkey % 40 <= 15 THEN 'arrived' ELSE 'late' END AS status
        FROM orders WHERE o_orderkey >= 100 AND o_orderstatus = 'F'""",
    "snapshot_progress": """
        SELECT connector, count(*) AS tables, count(*) FILTER (WHERE t < s) AS tables_remaining,
               CAST(sum(t) AS BIGINT) AS rows_scanned, CAST(sum(t) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS ratio
        FROM (SELECT 'c' || c_nationkey AS connector, c_custkey, count(*) AS s,
                     count(*) FILTER (WHERE o_orderkey % 17 <> 0) AS t
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY connector""",
}
