"""Trees of digests: two tables compare from the root down, and rows meet only where leaves differ.

A leaf is a range of ``2 ** leaf_bits`` values of the first key column if that is a whole number, else a
range of a hash of the key. One aggregate gives the leaves of a table; a node's digest is the sum of its
children's, so the upper levels cost nothing more, and a tree may be stored and sent in place of its
table. The descent joins, level by level, only children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from rowtide.sources.tables import cut_lineage

LEAF_BITS = 12
#: Bits of a hash of the key that tell leaves apart where keys are not whole numbers.
HASH_LEAF_BITS = 20
#: A node has up to 2 ** FAN_BITS children.
FAN_BITS = 10
#: Ranges of leaves that a scan is told; it may read a little more than the leaves that differ.
RANGES = 64


def _whole(df: DataFrame, key: list[str]) -> bool:
    return isinstance(df.schema[key[0]].dataType, ByteType | ShortType | IntegerType | LongType)


def leaf(df: DataFrame, key: list[str], leaf_bits: int = LEAF_BITS) -> Column:
    """Number of the leaf of a row. A null in a whole-number key counts as zero."""
    if _whole(df, key):
        return F.shiftright(F.coalesce(F.col(key[0]).cast("bigint"), F.lit(0).cast("bigint")), leaf_bits)
    return F.shiftright(F.xxhash64(*key), 64 - HASH_LEAF_BITS)


def row_digest(cols: list[str]) -> Column:
    """Digest of a row in which a null is told apart from an absent value in another column."""
    return F.xxhash64(*cols, F.array(*[F.isnull(c) for c in cols]))


def leaves(df: DataFrame, key: list[str], cols: list[str], leaf_bits: int = LEAF_BITS) -> DataFrame:
    """``(node, rows, digest)`` of every leaf that has rows; one aggregate, no order of rows matters."""
    digest = F.sum(row_digest(cols).cast("decimal(20,0)")).alias("digest")
    return df.groupBy(leaf(df, key, leaf_bits).alias("node")).agg(F.count("*").alias("rows"), digest)


def tree(bottom: DataFrame, height: int) -> DataFrame:
    """``(level, node, rows, digest)`` of a tree's nodes, from its leaves."""
    level = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")
    every = bottom.select("node", "rows", "digest", level)
    up = F.expr(f"shiftright(node, level * {FAN_BITS})")
    return every.groupBy("level", up.alias("node")).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))


def unequal_leaves(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    """``(node)``: leaves in which two trees differ, descending only below nodes that do."""
    found = None
    for level in range(height, -1, -1):
        sides = []
        for nodes in (a, b):
            here = nodes.where(F.col("level") == level).select("node", F.struct("rows", "digest").alias("own"))
            if found is not None:
                here = here.withColumn("up", F.shiftright("node", FAN_BITS)).join(found.withColumnRenamed("node", "up"), "up", "left_semi").drop("up")
            sides.append(here)
        met = sides[0].join(sides[1].withColumnRenamed("own", "other"), "node", "full")
        found = met.where(~F.col("own").eqNullSafe(F.col("other"))).select("node")
    return found


def _ranges(df: DataFrame, key: list[str], found: DataFrame, leaf_bits: int) -> Column:
    """A condition on the key itself that a scan can skip files and row groups by. At most ``RANGES``
    pairs of numbers come to the driver."""
    low, high = found.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return F.lit(False)
    slot = F.expr(f"cast((cast(node as decimal(20,0)) - {low}) * {RANGES} div {high - low + 1} as int)")
    spans = found.groupBy(slot.alias("slot")).agg(F.min("node").alias("a"), F.max("node").alias("b")).collect()
    first = F.col(key[0])
    told = [(first >= (r.a << leaf_bits)) & (first <= (r.b << leaf_bits | (1 << leaf_bits) - 1)) for r in spans]
    out = told[0]
    for one in told[1:]:
        out = out | one
    return out | first.isNull() if any(r.a <= 0 <= r.b for r in spans) else out


def _within(df: DataFrame, key: list[str], found: DataFrame, leaf_bits: int) -> DataFrame:
    rows = df.where(_ranges(df, key, found, leaf_bits)) if _whole(df, key) else df
    return rows.withColumn("_leaf", leaf(df, key, leaf_bits)).join(found.select(F.col("node").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns of either; a column that one does not have is null there."""
    def widen(df: DataFrame, other: DataFrame) -> DataFrame:
        missing = [c for c in other.columns if c not in df.columns]
        return df.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in missing}) if missing else df

    a, b = widen(a, b), widen(b, a)
    return a, b.select(*a.columns)


def unequal_rows(a: DataFrame, b: DataFrame, key: list[str], leaf_bits: int = LEAF_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of two tables with equal columns that lie in leaves that differ. Leaves that are alike
    are not read again where the key is a whole number and files are laid out by it."""
    bits = 64 - leaf_bits if _whole(a, key) else HASH_LEAF_BITS
    height = -(-bits // FAN_BITS)
    bottoms = [cut_lineage(leaves(df, key, a.columns, leaf_bits)) for df in (a, b)]
    found = cut_lineage(unequal_leaves(*[tree(x, height) for x in bottoms], height))
    return _within(a, key, found, leaf_bits), _within(b, key, found, leaf_bits)


def tree_diff(src: DataFrame, tgt: DataFrame, key: list[str], leaf_bits: int = LEAF_BITS) -> DataFrame:
    """``key``, ``status`` (missing, extra, changed) and ``columns`` (those that differ, of changed
    rows) of all rows in which two tables differ, null-safe.

    Keys are unique on both sides. A column that one side does not have is null there, so it differs
    where the other side has a value. Equal tables are told at the root; empty ones are equal.
    """
    src, tgt = aligned(src, tgt)
    a, b = unequal_rows(src, tgt, key, leaf_bits)
    values = [c for c in src.columns if c not in key]
    left = a.select(F.struct(*key).alias("_k"), F.struct(F.lit(1).alias("_here"), *values).alias("_s"))
    right = b.select(F.struct(*key).alias("_j"), F.struct(F.lit(1).alias("_here"), *values).alias("_t"))
    met = left.join(right, F.col("_k").eqNullSafe(F.col("_j")), "full")
    names = F.array_compact(F.array(*[F.when(~F.col("_s")[c].eqNullSafe(F.col("_t")[c]), F.lit(c)) for c in values]).cast("array<string>"))
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").otherwise("changed")
    told = met.select(F.coalesce("_k", "_j").alias("_k"), status.alias("status"), F.when(status == "changed", names).alias("columns"))
    return told.where("status <> 'changed' or size(columns) > 0").select("_k.*", "status", "columns")
