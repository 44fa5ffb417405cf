"""Mergeable sketches: latency spreads and key sets kept by hour, merged to longer spans later.

A stored hour is a few kilobytes whatever it counted, and merging hours gives what one pass over all
their rows would have given, within the same error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch and the rank error it keeps in 99 of 100 cases.
KLL_K, RANK_ERROR = 400, 0.0075
#: Size of a distinct-count sketch (2 ** 14 registers), and three times its relative standard error.
HLL_LG, COUNT_ERROR = 14, 3 * 0.0081
#: Size of a key-set sketch: sets up to so many keys are exact; the relative error of a larger one.
THETA_LG = 14
THETA_ERROR = 3 / 2 ** (THETA_LG / 2)


def hourly(df: DataFrame, by: list[str], ts: str, value: str, ident: str) -> DataFrame:
    """``by``, ``hour``, row count, sum, least and greatest value, and sketches of the values
    (``spread``) and of the distinct ``ident`` (``idents``). Null values count as rows, not as values."""
    v = F.col(value).cast("double")
    return df.groupBy(*by, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count("*").alias("rows"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_double(v, KLL_K).alias("spread"), F.hll_sketch_agg(F.col(ident).cast("string"), HLL_LG).alias("idents"))


def latency_rollup(hours: DataFrame, by: list[str], span: str = "day") -> DataFrame:
    """Stored hours merged to days (or weeks, months): nothing but the sketches is read."""
    return hours.groupBy(*by, F.date_trunc(span, "hour").alias(span)).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("spread", KLL_K).alias("spread"), F.hll_union_agg("idents").alias("idents"))


def quantile(q: float) -> Column:
    """Quantile of a roll-up, with a rank that is off by ``RANK_ERROR`` at most; null without values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("spread", F.lit(float(q))))


def distinct_idents() -> Column:
    return F.hll_sketch_estimate("idents")


def key_sketch(df: DataFrame, key: list[str]) -> DataFrame:
    """One row with a sketch of a table's key set; keys of several columns are told apart by a hash."""
    whole = F.xxhash64(*key, F.array(*[F.isnull(c) for c in key]))
    return df.agg(F.theta_sketch_agg(whole, THETA_LG).alias("keys"))


def key_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Estimated ``source_keys``, ``target_keys``, ``common``, ``missing`` and ``extra`` from the
    sketches of two tables, which may come from different sites. Each is off by ``THETA_ERROR`` of the
    union at most, and exact while both sets have no more keys than a sketch holds. It tells whether a
    comparison by key is worth its shuffle."""
    none = F.lit(None).cast("binary")
    both = a.select(F.col("keys").alias("a"), none.alias("b")).unionByName(b.select(none.alias("a"), F.col("keys").alias("b")))
    both = both.agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))  # of two rows
    size = F.theta_sketch_estimate
    return both.select(
        size("a").alias("source_keys"), size("b").alias("target_keys"), size(F.theta_intersection("a", "b")).alias("common"),
        size(F.theta_difference("a", "b")).alias("missing"), size(F.theta_difference("b", "a")).alias("extra"))
