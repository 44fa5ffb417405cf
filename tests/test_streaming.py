"""Streams in several batches against the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpers import EVENT, event, events, rows_of
from rowtide import streaming as st
from rowtide.operators import alerts as al
from rowtide.operators import apply as ap
from rowtide.sources.changes import read_changes
from rowtide.sources.profiles import Profile
from rowtide.sources.tables import stream_table
from rowtide.sources.versions import read_state
from test_apply import history

KEY = ["id"]
S = 1_000_000


def at(col):
    return F.timestamp_micros(F.col(col) * S)


def in_files(spark, path, frames):
    """One file per frame, so that each can become a batch of its own."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_upsert_in_batches_and_after_a_restart(spark, tmp_path):
    rows = history(9)
    log, where = str(tmp_path / "log"), [str(tmp_path / x) for x in ("table", "checkpoint", "staging")]
    table, checkpoint, staging = where
    for part in (rows[:80], rows[80:150]):
        events(spark, part).coalesce(1).write.mode("append").parquet(log)

    def run():
        schema = events(spark, []).schema
        stream = read_changes(spark, log, schema, Profile("t", "no_data", 1, 1, 1, 1, 1, 1, files_per_trigger=1))
        return st.stream_upsert(stream, table, KEY, 4, checkpoint, staging, "apply")

    assert len([p for p in run().recentProgress if p["numInputRows"]]) == 2
    events(spark, rows[150:] + rows[:20]).coalesce(1).write.mode("append").parquet(log)
    run()
    want = rows_of(ap.live(ap.upsert(None, events(spark, rows), KEY, "apply")))
    assert rows_of(ap.live(read_state(spark, table))) == want


def test_windows_updated_over_batches(spark, tmp_path):
    a = spark.createDataFrame([(t, "x") for t in range(0, 300, 10)], "t bigint, k string")
    b = spark.createDataFrame([(t, "x") for t in range(250, 600, 10)], "t bigint, k string")
    ev = in_files(spark, str(tmp_path / "in"), [a, b]).withColumn("ts", at("t"))
    agg = st.window_agg(ev, "60 seconds", ["k"], {"n": F.count("*")}, "10 minutes")
    st.update_sink(agg, str(tmp_path / "out"), str(tmp_path / "c"))
    out = st.latest_epoch(spark, str(tmp_path / "out"), ["window_start", "window_end", "k"])
    want = a.unionByName(b).groupBy(F.window(at("t"), "60 seconds")["start"].alias("window_start")).agg(F.count("*").alias("n"))
    assert rows_of(out.select("window_start", "n")) == rows_of(want)


def test_windows_drop_late_rows(spark, tmp_path):
    frames = [spark.createDataFrame([(t,) for t in ts], "t bigint") for ts in ([10, 20, 5000], [5010], [30, 40, 5020])]
    ev = in_files(spark, str(tmp_path / "in"), frames).withColumn("ts", at("t"))
    agg = st.window_agg(ev, "60 seconds", [], {"n": F.count("*")}, "5 minutes")
    st.run_now(agg, str(tmp_path / "out"), str(tmp_path / "c"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("n")) == [(2,)]


def test_late_rows_are_set_aside(spark, tmp_path):
    path, times = str(tmp_path / "out"), [[10, 20, 5000], [5010, None], [4710, 4709, 5020], [30]]
    frames = [spark.createDataFrame([(t,) for t in ts], "t bigint") for ts in times]
    ev = in_files(spark, str(tmp_path / "in"), frames).withColumn("ts", at("t"))
    for _ in range(2):  # the second run finds nothing new
        st.split_late(ev, path, str(tmp_path / "c"), 300)
    assert rows_of(st.late_rows(spark, path).select("batch", "t")) == [(2, 4709), (3, 30)]
    assert sorted(r.t for r in st.on_time_rows(spark, path).collect() if r.t) == [10, 20, 4710, 5000, 5010, 5020]
    assert st.on_time_rows(spark, path).where("t is null").count() == 1


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (50, "a"), (500, "a"), (0, "b"), (9000, "b")], "t bigint, k string")
    ev = in_files(spark, str(tmp_path / "in"), [df]).withColumn("ts", at("t"))
    out = st.session_agg(ev, "100 seconds", ["k"], {"n": F.count("*")}, "10 seconds")
    st.run_now(out, str(tmp_path / "out"), str(tmp_path / "c"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("k", "n")) == [("a", 1), ("a", 2), ("b", 1)]


def test_dedupe_over_batches(spark, tmp_path):
    # a row at the epoch itself would be late from the start, as the watermark begins there
    frames = [spark.createDataFrame([(i, 1_000 + i) for i in r], "id bigint, t bigint") for r in (range(0, 20), range(10, 30))]
    ev = in_files(spark, str(tmp_path / "in"), frames).withColumn("ts", at("t"))
    st.run_now(st.dedupe_stream(ev, ["id"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))


def test_hold_online_equals_hold_in_batch(spark, tmp_path):
    ticks = [(15 * i, (i // 12) % 2 == 0 and i % 37 != 5) for i in range(200)]
    frames = [spark.createDataFrame(ticks[i:i + 50], "t bigint, active boolean") for i in range(0, 200, 50)]

    def flags(df):
        return df.select(
            F.lit("A").alias("alertname"), F.lit("warning").alias("severity"), F.lit("n").alias("node"),
            F.lit("s").alias("series"), F.lit(60).alias("for_s"), at("t").alias("ts"), "active")

    ev = flags(in_files(spark, str(tmp_path / "in"), frames))
    st.run_now(st.stream_hold(ev, 15), str(tmp_path / "out"), str(tmp_path / "c"))
    online = spark.read.parquet(str(tmp_path / "out")).filter("state = 'firing'").select(F.unix_seconds("at").alias("t"))
    batch = al.hold_for(flags(spark.createDataFrame(ticks, "t bigint, active boolean")), 15).filter("state = 'firing'")
    assert rows_of(online) == rows_of(batch.select(F.unix_seconds(F.col("firing_at").cast("timestamp")).alias("t")))
    told = spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("at").alias("t"), "state")
    assert rows_of(told, ["t", "state"]) == sorted(plain_hold(ticks, 15, 60), key=lambda r: tuple((x is None, str(x)) for x in r))


def plain_hold(ticks, step, least):
    """Firing and resolved of one series, sample by sample."""
    out, start, last, fired = [], None, None, False
    for t, active in ticks:
        if last is not None and (not active or t - last > step):
            out += [(last, "resolved")] if fired else []
            start, last, fired = None, None, False
        if active:
            start, last = t if start is None else start, t
            if not fired and t - start >= least:
                fired = True
                out.append((t, "firing"))
    return out


def test_hold_with_gaps_repeats_and_odd_batches(spark, tmp_path):
    import random

    rng = random.Random(4)
    series = {s: [(15 * i, rng.random() < 0.9) for i in range(160) if rng.random() < 0.97] for s in "abc"}
    rows = sorted((t, active, s) for s, ticks in series.items() for t, active in ticks)
    cuts = [0, 1, 2, 90, 91, 300, len(rows)]
    frames = [spark.createDataFrame(rows[i:j] + rows[max(0, i - 2):i], "t bigint, active boolean, s string") for i, j in zip(cuts, cuts[1:])]
    ev = in_files(spark, str(tmp_path / "in"), frames).select(
        F.lit("A").alias("alertname"), F.lit("n").alias("node"), F.col("s").alias("series"), F.lit(60).alias("for_s"), at("t").alias("ts"), "active")
    st.run_now(st.stream_hold(ev, 15), str(tmp_path / "out"), str(tmp_path / "c"))
    got = rows_of(spark.read.parquet(str(tmp_path / "out")).select("series", F.unix_seconds("at").alias("t"), "state"), ["series", "t", "state"])
    assert got == sorted(((s, *x) for s, ticks in series.items() for x in plain_hold(ticks, 15, 60)), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_stream_reads_a_directory_of_part_files(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "nums.parquet"))
    st.run_now(stream_table(spark, str(tmp_path), "nums"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_event_schema_text_is_current(spark):
    row = events(spark, [event("c", 1, 1, "a", 1)])
    assert row.schema.simpleString() == spark.createDataFrame([], EVENT).schema.simpleString()
