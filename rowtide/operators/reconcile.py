"""Does the target hold what the source holds?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions.clock import micros
from rowtide.operators.windows import BUSY, DAY, busy_keys, cut_out, cut_out_whole, lasting, merge_intervals, next_start
from rowtide.sources.changes import union_all


def _side(df: DataFrame, name: str, side: str, key: list[str], approx: bool) -> DataFrame:
    ident = F.struct(*[F.col(k) for k in key])
    keys = F.approx_count_distinct(F.xxhash64(*key)) if approx else F.count_distinct(ident)
    return df.agg(F.count("*").alias("rows"), keys.alias("keys")).select(
        F.lit(name).alias("table"), F.lit(side).alias("side"), "rows", "keys"
    )


def count_parity(pairs: list[tuple[str, DataFrame, DataFrame, list[str]]], approx: bool = False) -> DataFrame:
    """Row counts and distinct keys of each (name, source, target, key) and whether they agree."""
    sides = []
    for name, src, tgt, key in pairs:
        sides += [_side(src, name, "source", key, approx), _side(tgt, name, "target", key, approx)]

    def pick(col: str, side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    out = union_all(sides).groupBy("table").agg(
        pick("rows", "source").alias("source_rows"),
        pick("rows", "target").alias("target_rows"),
        pick("keys", "source").alias("source_keys"),
        pick("keys", "target").alias("target_keys"),
    )
    same = (F.col("source_rows") == F.col("target_rows")) & (F.col("source_keys") == F.col("target_keys"))
    return out.withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def missing_extra(src: DataFrame, tgt: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has. Reads the key columns only."""
    a = src.select(*key).withColumn("_in_source", F.lit(True))
    b = tgt.select(*key).withColumn("_in_target", F.lit(True))
    both = a.join(b, key, "full")
    return both.filter(F.col("_in_source").isNull() | F.col("_in_target").isNull()).select(
        *key, F.when(F.col("_in_target").isNull(), "missing").otherwise("extra").alias("status")
    )


def _paired(src: DataFrame, tgt: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    a = src.select(*key, *[F.col(c).alias(f"_s_{c}") for c in cols])
    b = tgt.select(*key, *[F.col(c).alias(f"_t_{c}") for c in cols])
    return a.join(b, key)


def value_diff(src: DataFrame, tgt: DataFrame, key: list[str], cols: list[str] | None = None) -> DataFrame:
    """Per column: rows compared (keys on both sides) and rows that differ, null-safe."""
    cols = cols or [c for c in src.columns if c not in key]
    sums = _paired(src, tgt, key, cols).agg(
        F.count("*").alias("compared"),
        *[F.count_if(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}"))).alias(f"_{c}") for c in cols],
    )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("mismatches")) for c in cols])
    return sums.select("compared", F.inline(entries)).select("column", "compared", "mismatches")


def differing_rows(src: DataFrame, tgt: DataFrame, key: list[str], cols: list[str] | None = None) -> DataFrame:
    """Keys on both sides whose values differ, with the names of the differing columns."""
    cols = cols or [c for c in src.columns if c not in key]
    names = F.array_compact(
        F.array(*[F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}")), F.lit(c)) for c in cols])
    )
    out = _paired(src, tgt, key, cols).select(*key, names.alias("columns"))
    return out.filter(F.size("columns") > 0)


def bucket_checksum(df: DataFrame, key: list[str], n: int, cols: list[str] | None = None) -> DataFrame:
    """Row count and order-free digest per key bucket: two tables compare in n rows, no join of data."""
    cols = cols or df.columns
    bucket = F.pmod(F.xxhash64(*key), F.lit(n)).alias("bucket")
    digest = F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).alias("digest")
    return df.groupBy(bucket).agg(F.count("*").alias("rows"), digest)


def checksum_diff(src: DataFrame, tgt: DataFrame, key: list[str], n: int, cols: list[str] | None = None) -> DataFrame:
    """Buckets with both counts and whether they are equal; only unequal ones need a row compare."""
    cols = cols or src.columns
    a = bucket_checksum(src, key, n, cols).withColumnsRenamed({"rows": "source_rows", "digest": "_a"})
    b = bucket_checksum(tgt, key, n, cols).withColumnsRenamed({"rows": "target_rows", "digest": "_b"})
    return a.join(b, "bucket", "full").select(
        "bucket",
        F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
        F.coalesce("target_rows", F.lit(0)).alias("target_rows"),
        F.col("_a").eqNullSafe(F.col("_b")).alias("equal"),
    )


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose reference is set but has no parent.

    The references are made distinct first, so a value that many rows share is shuffled once;
    the orphan values found are then looked up in the child.
    """
    refs = child.select(F.col(fk)).filter(F.col(fk).isNotNull()).distinct()
    orphans = refs.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return child.join(orphans, fk, "left_semi")


def _held(log: DataFrame, by: list[str], keep: list[str], until: int, chunk: int) -> DataFrame:
    """Intervals, ends included, in which the rows of a change log hold: from the change that wrote
    them to the instant before the next change of the same key, or to ``until``."""
    nexts = next_start(log, by, "at", ["seq"], "_next", chunk)
    ends = F.coalesce(F.col("_next") - 1, F.lit(until).cast("bigint"))
    return nexts.where(~F.col("gone")).select(*keep, F.col("at").alias("start_us"), F.least(ends, F.lit(until)).alias("end_us")).where("start_us <= end_us")


def fk_violation_intervals(child: DataFrame, parent: DataFrame, ident: list[str], until: int, chunk: int = DAY,
                           busy: int = BUSY) -> DataFrame:
    """When the target held child rows without their parent, from the change logs applied to it.

    ``child`` has ``ident``, ``ref``, ``at``, ``seq`` and ``gone``; ``parent`` has ``ref``, ``at``, ``seq`` and
    ``gone``: when a change was applied, which of two at once came last, and whether it was a delete.
    The result, for instants up to ``until``, is ``ident``, ``ref``, ``since``, ``till`` (the first instant
    without the violation, null if it lasts) and ``state``: ``healed`` when the parent arrived, ``withdrawn``
    when the child changed its reference or went first, ``open`` otherwise. A null reference never
    violates; a change of the child that keeps its reference does not end an interval.

    A point-in-time anti join: what a child's reference interval has beyond all intervals of its parent.
    Intervals stay whole, so each log crosses the network once by its key and the children once more by
    what they name. Only keys in hash buckets of more than ``busy`` rows are cut into chunks of time, so
    a parent that a third of all rows name is many tasks.
    """
    kind = child.select("ref").union(parent.select("ref")).schema["ref"].dataType  # equal references hash alike
    own, named = busy_keys([child], [F.col(c) for c in ident], busy), busy_keys([child, parent], [F.col("ref").cast(kind)], busy)
    refs = lasting(child if own is None else child.where(~own), ident, ["ref", "gone"], ["seq"], until).where("ref is not null and not gone").drop("gone")
    if own is not None:
        often = _held(child.where(own), ident, [*ident, "ref"], until, chunk).where("ref is not null")
        refs = refs.unionByName(merge_intervals(often, [*ident, "ref"], 1, chunk))
    refs = refs.withColumn("_last", F.col("end_us"))
    there = lasting(parent if named is None else parent.where(~named), ["ref"], ["gone"], ["seq"], until).where("not gone").drop("gone")
    bare = cut_out_whole(refs if named is None else refs.where(~named), there, ["ref"])
    if named is not None:
        bare = bare.unionByName(cut_out(refs.where(named), _held(parent.where(named), ["ref"], ["ref"], until, chunk), ["ref"], 1, chunk))
    state = F.when(F.col("end_us") >= until, "open").when(F.col("end_us") == F.col("_last"), "withdrawn").otherwise("healed")
    return bare.select(*ident, "ref", F.col("start_us").alias("since"), F.when(state != "open", F.col("end_us") + 1).alias("till"), state.alias("state"))


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls per column that must not hold any; one pass for all columns."""
    sums = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in cols])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("nulls")) for c in cols])
    return sums.select("rows", F.inline(entries)).select(
        "column", "rows", "nulls", F.when(F.col("nulls") > 0, "FAIL").otherwise("PASS").alias("status")
    )


def schema_parity(cat_a: DataFrame, cat_b: DataFrame, on: list[str]) -> DataFrame:
    """Columns of two catalogs side by side. Catalogs have ``on`` plus (type, nullable)."""
    a = cat_a.select(*on, F.col("type").alias("type_a"), F.col("nullable").alias("null_a"))
    b = cat_b.select(*on, F.col("type").alias("type_b"), F.col("nullable").alias("null_b"))
    verdict = (
        F.when(F.col("type_b").isNull(), "missing_in_target")
        .when(F.col("type_a").isNull(), "extra_in_target")
        .when(F.col("type_a") != F.col("type_b"), "type_differs")
        .when(F.col("null_a") != F.col("null_b"), "nullability_differs")
        .otherwise("equal")
    )
    return a.join(b, on, "full").withColumn("verdict", verdict)


def schema_compat(registry: DataFrame) -> DataFrame:
    """Backward compatibility of each schema version with the one registered before it, however far
    apart their numbers are.

    ``registry`` has (subject, version, name, type, nullable, has_default). A reader on the new
    schema must be able to read old data: an added column must be nullable or have a default, a
    type may only be widened, a removed column is reported.
    """
    # Type changes a reader resolves by widening.
    widening = [("int", "bigint"), ("int", "double"), ("int", "float"), ("bigint", "double"),
                ("bigint", "float"), ("float", "double")]
    new = registry.select("subject", "version", "name", F.col("type").alias("new_type"),
                          (F.col("nullable") | F.col("has_default")).alias("optional"))
    order = Window.partitionBy("subject").orderBy("version")
    versions = registry.select("subject", "version").distinct().withColumn("before", F.lag("version").over(order))
    known = versions.where("before is not null")
    old = registry.select("subject", F.col("version").alias("before"), "name", F.col("type").alias("old_type"))
    old = old.join(known, ["subject", "before"]).select("subject", "version", "name", "old_type")
    new = new.join(known.select("subject", "version"), ["subject", "version"], "left_semi")
    pairs = F.concat_ws(">", "old_type", "new_type")
    verdict = (
        F.when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type").isNull() & F.col("optional"), "added_optional")
        .when(F.col("old_type").isNull(), "added_required")
        .when(F.col("old_type") == F.col("new_type"), "unchanged")
        .when(pairs.isin([f"{a}>{b}" for a, b in widening]), "widened")
        .otherwise("type_changed")
    )
    return new.join(old, ["subject", "version", "name"], "full").select(
        "subject", "version", "name", verdict.alias("verdict"),
        (~verdict.isin("added_required", "type_changed")).alias("compatible"),
    )


# Remedy per kind of schema change.
REMEDIES = {
    "added_optional": "none, the sink adds the column",
    "added_required": "give the column a default",
    "removed": "relax the subject's level until the change is through",
    "type_changed": "flush the topic and recreate the connector",
}


def compat_summary(registry: DataFrame) -> DataFrame:
    """One row per subject and version: is it compatible and which change decides the remedy."""
    cols = schema_compat(registry)
    worst = F.when(F.col("verdict") == "type_changed", 4).when(F.col("verdict") == "added_required", 3).when(
        F.col("verdict") == "removed", 2).when(F.col("verdict") == "added_optional", 1).otherwise(0)
    level = cols.groupBy("subject", "version").agg(
        F.min("compatible").alias("compatible"), F.max(worst).alias("_w"))
    by_level = {4: "type_changed", 3: "added_required", 2: "removed", 1: "added_optional"}
    remedy = F.lit("none")
    for w, kind in by_level.items():
        remedy = F.when(F.col("_w") == w, REMEDIES[kind]).otherwise(remedy)
    return level.select("subject", "version", "compatible", remedy.alias("remedy"))


def propagation(src: DataFrame, tgt: DataFrame, key: str, marker_col: str, marker: str, pk_start: int,
                wait_s: int, src_ts: str, tgt_ts: str) -> DataFrame:
    """Did the marker rows at or above ``pk_start`` arrive within the wait?"""
    marked = src.filter((F.col(key) >= pk_start) & (F.col(marker_col) == marker))
    sent = marked.select(key, micros(F.col(src_ts)).alias("_sent"))
    seen = tgt.filter(F.col(key) >= pk_start).select(key, micros(F.col(tgt_ts)).alias("_seen"))
    delay = (F.col("_seen") - F.col("_sent")) / F.lit(1_000_000.0)
    status = F.when(F.col("_seen").isNull(), "lost").when(delay <= wait_s, "arrived").otherwise("late")
    return sent.join(seen, key, "left").select(key, delay.alias("delay_s"), status.alias("status"))


def loop_check(forward: DataFrame, reverse: DataFrame, origin_header: str, origin: str) -> DataFrame:
    """Reverse events that are an echo: their key went forward and they carry the origin of the
    side they are about to return to."""
    home = F.try_element_at(F.col("headers"), F.lit(origin_header)) == origin
    return reverse.filter(home).join(forward.select("key").distinct(), "key", "left_semi")


def snapshot_progress(progress: DataFrame) -> DataFrame:
    """Progress per connector from (connector, table, source_rows, target_rows)."""
    done = F.col("target_rows") >= F.col("source_rows")
    return progress.groupBy("connector").agg(
        F.count("*").alias("tables"),
        F.count_if(~done).alias("tables_remaining"),
        F.sum("target_rows").alias("rows_scanned"),
        (F.sum("target_rows") / F.sum("source_rows")).alias("ratio"),
    )
