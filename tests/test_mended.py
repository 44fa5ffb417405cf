"""Faults that once passed the SQL comparison."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import event, events, rows_of
from rowtide import streaming as st
from rowtide.functions.types import map_types
from rowtide.operators import alerts as al
from rowtide.operators import telemetry
from rowtide.operators.apply import dedupe_delivery, live, merge_batch, split_documents, table_view
from rowtide.plans.logs import orders, scrape
from rowtide.sources.changes import replay, snapshot_events
from rowtide.sources.versions import read_state

ROOT = "/root/testdata/sf0.001"


def test_snapshot_survives_deduplication(spark):
    rows = orders(spark, ROOT)
    snap = snapshot_events(rows, "p.db.dbo.orders", ["o_orderkey"], 0)
    assert dedupe_delivery(snap).count() == rows.count()
    assert dedupe_delivery(snap.unionByName(snap)).count() == rows.count()
    logged = events(spark, [event("u", 1, 10, offset=5), event("u", 1, 10, offset=5), event("u", 1, 10, offset=6)])
    assert dedupe_delivery(logged).count() == 2


def test_uncommitted_partitions_count_in_full(spark):
    ends = spark.createDataFrame([("t", 0, 100), ("t", 1, 5000), ("u", 0, 9)], "topic string, partition int, end_offset long")
    done = spark.createDataFrame([("g", "t", 0, 100), ("h", "u", 0, 9), ("k", "u", 7, 1)], "group string, topic string, partition int, committed long")
    reads = spark.createDataFrame([("g", "t", 0), ("g", "t", 1), ("h", "u", 0)], "group string, topic string, partition int")
    got = {r["group"]: (r.lag, r.status) for r in telemetry.consumer_lag(ends, done, reads).collect()}
    assert got == {"g": (5000, "FAIL"), "h": (0, "PASS"), "k": (None, "UNKNOWN")}


def test_replayed_batch_number_is_applied(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    merge_batch(spark, path, events(spark, [event("c", 1, 10, "old", 1)]), ["id"], 2, 0, staging)
    merge_batch(spark, path, events(spark, [event("u", 1, 20, "mid", 1)]), ["id"], 2, 1, staging)
    merge_batch(spark, path, events(spark, [event("u", 1, 30, "new", 1), event("c", 3, 31, "x", 1)]), ["id"], 2, 0, staging)
    rows = {r.id: r.name for r in live(read_state(spark, path)).collect()}
    assert rows == {1: "new", 3: "x"}


def test_same_batch_number_again_with_other_events(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    for lsn, name in ((10, "old"), (20, "new")):
        merge_batch(spark, path, events(spark, [event("c", 1, lsn, name, 1)]), ["id"], 2, 0, staging)
    assert [r.name for r in live(read_state(spark, path)).collect()] == ["new"]


def test_unreadable_documents_are_dead_letters(spark):
    schema = StructType.fromDDL("a int, b string")
    values = ['{"a":1,"b":"x"}', '{"a":1,"b"', '{"a":"N/A","b":"x"}', "", None, '{"a":null}']
    rows = [("t", str(i), "u", v) for i, v in enumerate(values)] + [("t", "6", "d", None), ("t", "7", None, None), ("other", "8", "u", "?")]
    log = spark.createDataFrame(rows, "target string, key string, op string, value string")
    good, dead = split_documents(log, {"t": schema})
    assert sorted(r.key for r in good.collect()) == ["0", "5", "6", "7", "8"]
    assert sorted(r.key for r in dead.collect()) == ["1", "2", "3", "4"]
    read, unread = table_view(log.filter("key < '6'"), "t", schema)
    assert sorted((r.key, r.a) for r in read.collect()) == [("0", 1), ("5", None)]
    assert sorted(r.key for r in unread.collect()) == ["1", "2", "3", "4"]


def test_values_that_do_not_fit_are_named(spark):
    rows = spark.createDataFrame([("1", "2"), ("N/A", "3"), (None, "x")], "a string, b string")
    got = map_types(rows, {"a": "BIGINT", "b": "INT"}).collect()
    assert [(r.a, r.b, r.type_error) for r in got] == [(1, 2, None), (None, 3, "a"), (None, None, "b")]


def test_held_alert_of_a_vanished_series_is_resolved(spark, tmp_path):
    def tick(series, t, active=True):
        return series, 100_000 + t, active

    batches = [
        [tick("gone", t) for t in range(0, 90, 15)] + [tick("stays", t) for t in range(0, 90, 15)],
        [tick("stays", 45, False)] + [tick("stays", t) for t in range(90, 600, 15)],  # the first one comes late
        [tick("stays", 600)],
    ]
    schema = "series string, t bigint, active boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flags = ticks.select(F.lit("A").alias("alertname"), F.lit("n").alias("node"), "series", F.lit(60).alias("for_s"),
                         F.timestamp_seconds("t").alias("ts"), "active")
    st.run_now(st.stream_hold(flags, 15, "100 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "out")).select("series", F.unix_seconds("at").alias("t"), "state")
    assert sorted(tuple(r) for r in out.collect()) == [
        ("gone", 100_060, "firing"), ("gone", 100_075, "resolved"), ("stays", 100_060, "firing")]


def test_notifications_of_what_inhibition_left(spark):
    s = 1_000_000
    rows = [
        ("lag", "warning", "n1", "a", 0, 600), ("lag", "critical", "n1", "a", 120, 300), ("lag", "critical", "n1", "b", 300, 405),
        ("lag", "warning", "n2", "a", 0, 45), ("disk", None, "n1", "a", 15, 30), ("lag", "warning", "n3", "a", 0, 900), ("lag", "warning", "n3", "b", 615, 900),
    ]
    fires = spark.createDataFrame([(*r[:4], r[4] * s, r[5] * s) for r in rows], "alertname string, severity string, node string, series string, start_us bigint, end_us bigint")
    heard = al.inhibit(fires, 15, chunk_us=200 * s)
    left = sorted((r.node, r.series, r.start_us // s, r.end_us // s) for r in heard.where("severity = 'warning'").collect())
    assert left == [("n1", "a", 0, 105), ("n1", "a", 420, 600), ("n2", "a", 0, 45), ("n3", "a", 0, 900), ("n3", "b", 615, 900)]
    assert heard.where("severity is null or severity = 'critical'").count() == 3
    told = al.notifications(heard, 15, chunk_us=200 * s)
    got = sorted((r.severity, r.node, r.at.minute * 60 + r.at.second, r.kind) for r in told.where("severity is not null").collect())
    assert got == [
        ("critical", "n1", 130, "first"), ("critical", "n1", 430, "resolved"),  # "b" would be told at 430, when all is over
        ("warning", "n1", 60, "first"), ("warning", "n1", 360, "resolved"), ("warning", "n1", 480, "first"), ("warning", "n1", 780, "resolved"),
        ("warning", "n3", 60, "first"), ("warning", "n3", 660, "update"), ("warning", "n3", 960, "resolved"),
    ]


def test_rules_meet_only_samples_that_fit(spark):
    rules = [
        al.AlertRule("it's", "value", "m", ">=", 2, 0, "warning", regex={"topic": "dlq-.*"}, not_regex={"node": "x|y"}),
        al.AlertRule("twice", "value", "m", "!=", 2, 0, "critical"), al.AlertRule("twice", "value", "m", "<", 2, 0, "warning", eq={"node": ""}),
    ]
    rows = [("m", {"topic": "dlq-a"}, 2.0), ("m", {"topic": "a-dlq-"}, 3.0), ("m", {"topic": "dlq-a", "node": "y"}, 3.0), ("o", {}, 1.0), ("m", {}, None)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string, string>, value double").withColumn("ts", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    got = sorted((r.alertname, r.severity, r.node, r.value or 0.0, r.active) for r in al.evaluate(samples, rules).collect())
    assert got == [
        ("it's", "warning", "", 2.0, True),
        ("twice", "critical", "", 0.0, False), ("twice", "critical", "", 2.0, False), ("twice", "critical", "", 3.0, True), ("twice", "critical", "y", 3.0, True),
        ("twice", "warning", "", 0.0, False), ("twice", "warning", "", 2.0, False), ("twice", "warning", "", 3.0, False),
    ]


def test_replay_never_broadcasts_the_log(spark, tmp_path):
    """Ranges of unknown size leave the log where it is, however small its files are; rows without an
    offset, overlapping ranges and open ends count as before."""
    rows = [("t", p, None if o == 99 else o) for p in (0, 1) for o in range(100)] + [("u", 0, 5), (None, 0, 5)]
    spark.createDataFrame(rows, "topic string, partition int, offset bigint").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    ranges = spark.createDataFrame(
        [("t", 0, 10, 20), ("t", 0, 15, 17), ("t", 1, None, 3), ("t", 1, 98, None), ("u", 0, None, None), (None, 0, None, None)],
        "topic string, partition int, start bigint, end bigint")
    got = replay(log, ranges)
    wanted = [("t", 0, o) for o in (*range(10, 20), 15, 16)] + [("t", 1, o) for o in (0, 1, 2, 98)] + [("u", 0, 5)]
    assert rows_of(got, ["topic", "partition", "offset"]) == sorted([tuple(r) for r in wanted], key=lambda r: [(x is None, str(x)) for x in r])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_rules_meet_series_and_frames_carry_numbers(spark):
    """Label conditions are not read for each sample, and what is laid out in time has neither labels nor
    names, in as many tasks as the session shuffles to."""
    plan = al.evaluate(scrape(spark, ROOT))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "try_element_at" not in plan.lower()
    frames = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(frames) >= 4 and not any("series" in line or "metric" in line for line in frames)
