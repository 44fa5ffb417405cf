"""Delivered log offsets as sets of ranges.

A range set is ``(topic, partition, start, end)``, ends included: a handful of rows where one for each
event would be needed, however long ago it came. It tells deliveries that come again beyond any
watermark, and offsets that never came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.operators.windows import cut_out, merge_intervals, merge_runs, split_intervals

LOG = ["topic", "partition"]
#: Offsets that are ordered together; any number gives the same result.
CHUNK = 1 << 18


def _as_times(ranges: DataFrame) -> DataFrame:
    return ranges.select(*LOG, F.col("start").cast("bigint").alias("start_us"), F.col("end").cast("bigint").alias("end_us"))


def _as_ranges(times: DataFrame) -> DataFrame:
    return times.select(*LOG, F.col("start_us").alias("start"), F.col("end_us").alias("end"))


def offset_ranges(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The offsets of ``events(topic, partition, offset)`` as a range set.

    Offsets are ordered within chunks of a partition, so a partition with most events is many tasks,
    and only the first and last range of each chunk are ordered across them. Repeated offsets count
    once; events without a position are left out; no events give no ranges.
    """
    placed = events.select(*LOG, F.col("offset").cast("bigint").alias("offset")).where("topic is not null and partition is not null and offset is not null")
    return _as_ranges(merge_runs(placed, LOG, F.col("offset"), 1, chunk_us=chunk))


def merge_ranges(*sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Union of range sets; ranges that overlap or follow each other become one."""
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    return _as_ranges(merge_intervals(_as_times(every), LOG, 1, chunk))


def subtract_ranges(ranges: DataFrame, gone: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What of a range set is not in another one."""
    return _as_ranges(cut_out(_as_times(ranges), _as_times(gone), LOG, 1, chunk))


def offset_gaps(ranges: DataFrame, begin: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(topic, partition, start, end, lost)``: offsets that no range holds though later ones came.

    A partition is looked at from its first range, or from ``begin(topic, partition, start)``, up to
    its last range; a partition of ``begin`` of which nothing came has no end, so no gap is known.
    """
    whole = ranges.groupBy(*LOG).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if begin is not None:
        from_ = begin.groupBy(*LOG).agg(F.min("start").cast("bigint").alias("begin"))
        whole = whole.join(from_, LOG, "left").withColumn("start", F.least("start", "begin")).drop("begin")
    return subtract_ranges(whole, ranges, chunk).withColumn("lost", F.col("end") - F.col("start") + 1)


def dedupe_by_ranges(events: DataFrame, delivered: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``events`` without those whose offset is in the range set ``delivered``, and one of each offset.

    The ranges are cut at chunk borders and gathered to a row for each chunk, so an event meets one
    row. A chunk has at most ``chunk / 2`` ranges; one where nothing was lost has a single one. Events
    without a position are all kept.
    """
    pieces = split_intervals(_as_times(merge_ranges(delivered, chunk=chunk)), chunk)
    known = pieces.groupBy(*LOG, "_chunk").agg(F.collect_list(F.struct("_s", "_e")).alias("_known"))
    placed = F.col("topic").isNotNull() & F.col("partition").isNotNull() & F.col("offset").isNotNull()
    at = F.col("offset").cast("bigint")
    laid = events.withColumn("_chunk", at - F.pmod(at, F.lit(chunk)))
    met = laid.join(known, [*LOG, "_chunk"], "left")
    seen = F.exists("_known", lambda r: (r["_s"] <= F.col("offset")) & (F.col("offset") <= r["_e"]))
    fresh = met.where(~F.coalesce(seen, F.lit(False)))
    own = fresh.withColumn("_own", F.when(~placed, F.monotonically_increasing_id()))
    return own.dropDuplicates([*LOG, "offset", "_own"]).select(*events.columns)
