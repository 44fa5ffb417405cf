"""Dead letters: rows that fail a check leave the main path with the reason attached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the context headers a sink attaches to a failed record.
HEADER = "__connect.errors."
CONTEXT_HEADERS = ["topic", "partition", "offset", "connector.name", "stage", "exception.class.name",
                   "exception.message"]

# Cause -> (stage, exception class) of the failures a sink can meet.
CAUSES = {
    "type_mismatch": ("VALUE_CONVERTER", "DataException"),
    "null_key": ("KEY_CONVERTER", "ConnectException"),
    "schema_incompatible": ("VALUE_CONVERTER", "SerializationException"),
    "constraint_violation": ("TASK_PUT", "SQLIntegrityConstraintViolationException"),
    "connection_error": ("TASK_PUT", "RetriableException"),
}


@dataclass(frozen=True)
class Rule:
    """A check: rows for which ``failed`` is true go to the dead letters."""

    cause: str
    failed: Column
    message: Column

    def error(self) -> Column:
        stage, exc = CAUSES[self.cause]
        return F.when(
            self.failed,
            F.struct(
                F.lit(self.cause).alias("cause"), F.lit(stage).alias("stage"),
                F.lit(exc).alias("exception_class"), self.message.alias("message"),
            ),
        )


def tag_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``error``, the first rule a row breaks, or null. Use this form to write both sides of
    the split in one pass."""
    return df.withColumn("error", F.coalesce(*[r.error() for r in rules]))


def split_dlq(df: DataFrame, rules: list[Rule], sink: str, mode: str = "dlq") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). Together they are the input; no row is in both.

    ``mode='skip'`` is the source side, which has no dead-letter topic: the second frame only
    counts the skipped rows per cause.
    """
    tagged = tag_errors(df, rules)
    good = tagged.filter(F.col("error").isNull()).drop("error")
    bad = tagged.filter(F.col("error").isNotNull())
    if mode == "skip":
        return good, bad.groupBy(F.col("error.cause").alias("cause")).agg(F.count("*").alias("skipped"))
    return good, bad.select("*", F.lit(sink).alias("sink")).withColumn("context", context_headers(df, sink))


def context_headers(df: DataFrame, sink: str) -> Column:
    """Header map that tells where a record came from and why it failed."""
    def place(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    values = [place("topic"), place("partition"), place("offset"), F.lit(sink), F.col("error.stage"),
              F.col("error.exception_class"), F.col("error.message")]
    pairs = [x for name, v in zip(CONTEXT_HEADERS, values) for x in (F.lit(HEADER + name), v)]
    return F.create_map(*pairs)


def dlq_summary(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("sink", F.col("error.stage").alias("stage"), F.col("error.cause").alias("cause")).agg(
        F.count("*").alias("records")
    )


def replay_dlq(dlq: DataFrame, chosen: Column, fixes: dict[str, Column], rules: list[Rule], sink: str
               ) -> tuple[DataFrame, DataFrame]:
    """Take the chosen dead letters, repair columns, check again.

    Returns (rows that may be applied now, dead letters that remain). What was not chosen
    stays; replay is always asked for, never automatic.
    """
    is_chosen = F.coalesce(chosen, F.lit(False))
    repaired = dlq.filter(is_chosen).drop("error", "sink", "context").withColumns(fixes)
    good, still = split_dlq(repaired, rules, sink)
    return good, dlq.filter(~is_chosen).unionByName(still, allowMissingColumns=True)


def retain(log: DataFrame, now: Column, max_age_s: int, max_bytes: int, size: Column,
           chunk_offsets: int = 1_000_000) -> DataFrame:
    """Records younger than ``max_age_s`` and within the newest ``max_bytes`` of their partition.

    The byte limit needs a running sum from the newest record backwards. It is done in two
    levels so that a topic partition with a large share of all records is never sorted by one
    task: sizes are added up per chunk of offsets, chunks wholly inside or outside the limit
    are decided by a join with those sums, and only the one chunk per topic partition that the
    limit cuts through is summed record by record.
    """
    place = ["topic", "partition"]
    young = log.filter(F.col("ts") >= now - F.make_dt_interval(secs=F.lit(max_age_s)))
    young = young.withColumns(
        {"_size": size.cast("bigint"), "_chunk": F.floor(F.col("offset") / F.lit(chunk_offsets)).cast("bigint")}
    )
    sums = young.groupBy(*place, "_chunk").agg(F.sum("_size").alias("_bytes"))
    newest_first = Window.partitionBy(*place).orderBy(F.col("_chunk").desc())
    through = sums.withColumn("_through", F.sum("_bytes").over(newest_first)).withColumn(
        "_before", F.col("_through") - F.col("_bytes")
    )
    cut = through.filter(F.col("_before") < max_bytes).drop("_bytes")
    placed = young.join(cut, place + ["_chunk"])
    inside = placed.filter(F.col("_through") <= max_bytes)
    in_chunk = Window.partitionBy(*place, "_chunk").orderBy(F.col("offset").desc())
    edge = (
        placed.filter(F.col("_through") > max_bytes)
        .withColumn("_run", F.col("_before") + F.sum("_size").over(in_chunk))
        .filter(F.col("_run") <= max_bytes)
        .drop("_run")
    )
    return inside.unionByName(edge).drop("_size", "_chunk", "_through", "_before")
