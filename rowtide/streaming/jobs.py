"""Streaming jobs. Event time is the ``timestamp`` column ``ts``; ``event_time`` makes one from
the zone-less timestamps of the tables. State is bounded by the watermark everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowtide.operators.apply import merge_batch


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def window_agg(ev: DataFrame, window: str, by: list[str], aggs: dict[str, Column], watermark: str,
               slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) window aggregate."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return ev.withWatermark(ts, watermark).groupBy(w.alias("w"), *by).agg(
        *[c.alias(n) for n, c in aggs.items()]
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggs)


def session_agg(ev: DataFrame, gap: str, by: list[str], aggs: dict[str, Column], watermark: str, ts: str = "ts"
                ) -> DataFrame:
    """Session-window aggregate; a session is given out once the watermark has passed its end."""
    return ev.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(
        *[c.alias(n) for n, c in aggs.items()]
    ).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggs)


def interval_join_stream(a: DataFrame, b: DataFrame, key: list[str], ta: str, tb: str, low: str, high: str,
                         watermark: str, how: str = "inner") -> DataFrame:
    """Stream-stream join on key and ``ta + low <= tb <= ta + high``."""
    left = a.withWatermark(ta, watermark).alias("a")
    right = b.withWatermark(tb, watermark).alias("b")
    on = (F.col(f"b.{tb}") >= F.col(f"a.{ta}") + F.expr(f"interval {low}")) & (
        F.col(f"b.{tb}") <= F.col(f"a.{ta}") + F.expr(f"interval {high}"))
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return left.join(right, on, how)


def enrich(ev: DataFrame, dim: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Stream-static join. The static side is broadcast by Spark while it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled by key beyond that."""
    return ev.join(dim, key, how)


def dedupe_stream(ev: DataFrame, ident: list[str], watermark: str, ts: str = "ts") -> DataFrame:
    """First row per identity; state is kept for as long as the watermark delay."""
    return ev.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(ident)


def _start(writer: DataStreamWriter, trigger: dict | None) -> StreamingQuery:
    """Without a trigger, process all that is there and stop; with one (``Profile.trigger``), leave
    the query running and hand it over."""
    q = writer.trigger(**(trigger or {"availableNow": True})).start()
    if not trigger or "availableNow" in trigger:
        q.awaitTermination()
    return q


def run_now(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Append the results to files; by default of all that is there, then stop."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return _start(writer.option("path", path), trigger)


def update_sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each batch's changed result rows below ``epoch=<batch>``; a repeated batch
    overwrites its own folder. ``latest_epoch`` reads the current result."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return _start(df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write), trigger)


def latest_epoch(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in key + ["epoch"]]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "epoch").alias("_row"))
    return best.select(*key, "_row.*")


def split_late(events: DataFrame, path: str, checkpoint: str, delay_s: int, ts: str = "ts", trigger: dict | None = None) -> StreamingQuery:
    """Write a stream to ``path`` with the rows that come behind the watermark set aside, not dropped.

    The watermark of a batch is the newest time of all batches before it less ``delay_s``; a row older
    than it is late. A row without a time is on time. Each batch is written once, to ``batch=<n>``, beside
    the newest time so far, so a repeated batch writes the same again and nothing is forgotten however
    many batches there are. ``late_rows`` and ``on_time_rows`` read the two sides.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/newest/batch={n - 1}").first()["newest"] if n else None
        line = F.lit(None).cast("timestamp") if before is None else F.lit(before) - F.make_dt_interval(secs=F.lit(delay_s))
        seen = Observation()
        told = batch.withColumn("late", F.coalesce(F.col(ts) < line, F.lit(False))).observe(seen, F.max(ts).alias("newest"))
        told.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={n}")
        newest = max((t for t in (before, seen.get["newest"]) if t is not None), default=None)
        spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/batch={n}")

    return _start(event_time(events, ts).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), trigger)


def _side(spark: SparkSession, path: str, late: bool) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where(F.col("late") == late).drop("late")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``split_late`` found behind the watermark, with the number of their batch."""
    return _side(spark, path, True)


def on_time_rows(spark: SparkSession, path: str) -> DataFrame:
    return _side(spark, path, False)


def stream_upsert(events: DataFrame, path: str, key: list[str], buckets: int, checkpoint: str, staging: str,
                  deletes: str = "drop", added: dict[str, int] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Apply a stream of change events to a bucketed state table, batch by batch.

    ``merge_batch`` is safe to repeat at any time, so a lost executor or driver costs no data and
    applies nothing twice, and several streams may write to one table. ``read_state`` reads it.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, path, batch, key, buckets, batch_id, staging, deletes, added)

    return _start(events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge), trigger)


HOLD_OUT = "alertname string, node string, series string, at timestamp, state string"
HOLD_STATE = "start_us bigint, last_us bigint, fired boolean"


def stream_hold(flags: DataFrame, step_s: int, watermark: str | None = None) -> DataFrame:
    """Alert holding while the stream runs: ``firing`` when the condition has held for ``for_s``,
    ``resolved`` when a fired condition ends.

    Rule evaluations come once per grid point of a series, so what one call sees of a series in one
    batch is bounded by the grid points of that batch. The state is three numbers
    per series; a sample not newer than the last one is ignored. With a ``watermark``, a series
    that stops reporting ends when the watermark has passed its next grid point: its alert is
    resolved and its state goes.
    """
    step = step_s * 1_000_000

    def runs(t: np.ndarray, active: np.ndarray, least: int, start, last, fired):
        """Changes of state over the samples of one batch, and what is left of the last run. Work
        follows the runs, not the samples."""
        out = []
        joined = np.append(last is not None and len(t) > 0 and t[0] - last <= step, active[:-1] & (np.diff(t) <= step))[: len(t)]
        firsts = np.flatnonzero(active & ~joined)
        carries = len(t) > 0 and bool(active[0] and joined[0])
        if len(t) and start is not None and not carries:
            out += [(last, "resolved")] if fired else []
            start, last, fired = None, None, False
        ends = np.flatnonzero(active & ~np.append(active[1:] & joined[1:], False)[: len(t)])
        for first, end in zip([0] * carries + firsts.tolist(), ends.tolist()):
            start, fired = (start, fired) if carries and first == 0 else (int(t[first]), False)
            at = first + int(np.searchsorted(t[first : end + 1], start + least))
            if not fired and at <= end:
                fired = True
                out.append((int(t[at]), "firing"))
            last = int(t[end])
            if end < len(t) - 1:
                out += [(last, "resolved")] if fired else []
                start, last, fired = None, None, False
        return out, (start, last, fired)

    def hold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alertname, node, series, for_s = key
        start, last, fired = state.get if state.exists else (None, None, False)
        out = []
        if state.hasTimedOut:
            out += [(last, "resolved")] if fired else []
            start = None
        else:
            rows = pd.concat(list(chunks)).sort_values("t_us", kind="stable").drop_duplicates("t_us")
            rows = rows if last is None else rows[rows["t_us"] > last]
            t, active = rows["t_us"].to_numpy(), rows["active"].to_numpy(bool)
            out, (start, last, fired) = runs(t, active, int(for_s) * 1_000_000, start, last, fired)
        if start is None:
            state.remove()
        else:
            state.update((int(start), int(last), bool(fired)))
            if watermark:
                state.setTimeoutTimestamp(max((int(last) + step) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "alertname": [alertname] * len(out), "node": [node] * len(out), "series": [series] * len(out),
                "at": pd.to_datetime([t for t, _ in out], unit="us", utc=True), "state": [s for _, s in out],
            }
        )

    timed = event_time(flags)
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    timed = timed.select("alertname", "node", "series", "for_s", "ts", F.unix_micros("ts").alias("t_us"), "active")
    ends = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return timed.groupBy("alertname", "node", "series", "for_s").applyInPandasWithState(
        hold, HOLD_OUT, HOLD_STATE, "append", ends
    )
