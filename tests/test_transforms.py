from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import event, events, rows_of
from rowtide.functions import names, positions, types
from rowtide.operators import alerts as al
from rowtide.operators import audit, dlq, metric_names, reconcile
from rowtide.operators import telemetry as tm
from rowtide.operators import transforms as tr
from rowtide.sources import changes as ch
from rowtide.sources import tables
from rowtide.sources.profiles import Profile


def one(spark, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema)


def test_route_needs_a_group_and_matches_the_whole_name(spark):
    with pytest.raises(ValueError):
        names.routed_name(F.col("x"), "sqlserver.*", "$1")
    out = names.routed_name(F.col("x"), r"a\.[^.]+\.dbo\.(.+)")
    assert [one(spark, v).select(out.alias("o")).first().o for v in ("a.d.dbo.t.x", "a.d.dbo.", "zz.a.d.dbo.t")] == [
        "t.x", "a.d.dbo.", "zz.a.d.dbo.t"]


def test_topic_parts(spark):
    got = [tuple(one(spark, v).select(names.topic_parts(F.col("x")).alias("p")).first().p) for v in ("a.b.c.d", "a.b.c", "a")]
    assert got == [("a", "b", "c", "d"), ("a", None, "b", "c"), ("a", None, None, None)]


def test_key_spec():
    assert tr.parse_key_spec("db.s.t:a,b; x.y : c ;") == {"db.s.t": ["a", "b"], "x.y": ["c"]}
    for bad in ("t", "t:", ":a"):
        with pytest.raises(ValueError):
            tr.parse_key_spec(bad)


def test_mask_keeps_nulls_and_types(spark):
    df = spark.createDataFrame([("a", 5, True), (None, None, None)], "s string, n int, b boolean")
    out = tr.mask_fields(df, ["s", "n", "b"], "*")
    assert [tuple(r) for r in out.collect()] == [("*", 0, False), (None, None, None)]
    assert out.schema == df.schema
    with pytest.raises(ValueError):
        tr.mask_fields(df, ["nope"])
    odd = spark.createDataFrame([(bytearray(b"x"), [1])], "raw binary, many array<int>")
    assert bytes(tr.mask_fields(odd, ["raw"]).first().raw) == b""
    with pytest.raises(TypeError):
        tr.mask_fields(odd, ["many"])


def test_origin_header(spark):
    ev = events(spark, [event("c", 1, 1), event("c", 2, 2, headers={"__origin": "a"}), event("c", 3, 3, headers={"x": "y"})])
    kept = tr.tag_origin(tr.drop_origin(ev, "a"), "b")
    assert sorted((r.key.id, r.headers["__origin"]) for r in kept.collect()) == [(1, "b"), (3, "b")]


def test_types(spark):
    assert types.map_type("DECIMAL(12, 2)") == ("NUMERIC(12,2)", "decimal(12,2)")
    assert types.map_type("NVARCHAR(200)") == ("VARCHAR(200)", "string")
    assert types.map_type("nvarchar(max)") == ("TEXT", "string")
    assert types.map_type("MONEY")[1] == "decimal(19,4)"
    with pytest.raises(ValueError):
        types.map_type("GEOGRAPHY")
    row = types.map_types(one(spark, "US "), {"x": "CHAR(3)"}).first()
    assert row.x == "US"


def test_positions(spark):
    df = spark.createDataFrame([("1/0", 4294967296), ("0/FF", 255), ("16/B374D848", 97500059720)], "p string, n bigint")
    assert all(r.a == r.n for r in df.select("n", positions.lsn_bytes(F.col("p")).alias("a")).collect())
    sizes = spark.createDataFrame([(0, "0 bytes"), (1023, "1023 bytes"), (1024, "1 kB"), (10485760, "10 MB"), (1 << 40, "1 TB")],
                                  "n bigint, t string")
    assert all(r.a == r.t for r in sizes.select("t", positions.size_text(F.col("n")).alias("a")).collect())


def test_decode(spark):
    reg = {1: StructType.fromDDL("id bigint"), 2: StructType.fromDDL("id bigint, note string")}
    rows = [(1, '{"id": 1}'), (2, '{"id": 2, "note": "x"}'), (2, '{"id": "x"}'), (2, "{bad"), (3, "{}"), (1, None)]
    out = ch.decode(spark.createDataFrame(rows, "schema_version int, value string"), reg).collect()
    assert [r.decode_ok for r in out] == [True, True, False, False, False, False]
    assert [tuple(r.after) if r.after else None for r in out[:3]] == [(1, None), (2, "x"), None]


def test_split_is_a_partition_of_the_input(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), rng.choice(["1", "x", None]), "s" * rng.randrange(30)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, v string, s string")
    rules = [dlq.Rule("null_key", F.col("k").isNull(), F.lit("no key")),
             dlq.Rule("type_mismatch", F.col("v").isNotNull() & F.col("v").try_cast("int").isNull(), F.lit("bad")),
             dlq.Rule("constraint_violation", F.length("s") > 20, F.lit("long"))]
    good, bad = dlq.split_dlq(df, rules, "sink")
    assert rows_of(good.unionByName(bad.select("k", "v", "s"))) == rows_of(df)
    assert all(r.k is not None and r.v != "x" and len(r.s) <= 20 for r in good.collect())
    first = bad.filter("k IS NULL").select("error.cause").distinct().collect()
    assert [r.cause for r in first] == ["null_key"]
    again, left = dlq.replay_dlq(bad, F.col("error.cause") == "type_mismatch", {"v": F.lit("0")}, rules, "sink")
    assert again.count() + left.count() == bad.count()
    assert again.filter(F.length("s") > 20).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_retention(spark, chunk):
    rng = random.Random(2)
    rows = [(t, p, o, rng.randrange(1, 40)) for t in ("a", "b") for p in (0, 1) for o in range(60 if t == "a" else 9)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, n int").withColumn(
        "ts", F.timestamp_micros(F.col("offset") * 1_000_000).cast("timestamp_ntz"))
    now = F.lit(datetime(1970, 1, 1, 0, 1)).cast("timestamp_ntz")
    got = dlq.retain(df, now, 45, 200, F.col("n"), chunk)
    want = []
    for t in ("a", "b"):
        for p in (0, 1):
            run = 0
            for r in sorted((r for r in rows if r[:2] == (t, p) and r[2] >= 15), key=lambda r: -r[2]):
                run += r[3]
                if run <= 200:
                    want.append(r)
    assert sorted((r.topic, r.partition, r.offset, r.n) for r in got.collect()) == sorted(want)


def test_exporter_attribute_as_prefix(spark):
    bean = ("debezium.sql_server<type=connector-metrics, server=s, task=0, context=streaming, database=d><>"
            "MilliSecondsBehindSourceP99")
    row = metric_names.normalise_metrics(one(spark, bean, "bean string"), metric_names.connect_rules()).first()
    assert (row.metric, row.type, row.labels["database"]) == ("debezium_metrics_milliseconds_behind_source", "GAUGE", "d")
    pg = "debezium.postgres<type=connector-metrics, context=streaming, server=s><>TotalNumberOfEventsSeen"
    row = metric_names.normalise_metrics(one(spark, pg, "bean string"), metric_names.connect_rules()).first()
    assert (row.metric, row.type) == ("debezium_metrics_totalnumberofeventsseen", "GAUGE")


def test_alert_gap_breaks_the_hold(spark):
    ticks = [(t, True) for t in range(0, 90, 15)] + [(t, True) for t in range(120, 300, 15)] + [(300, False), (315, True)]
    df = spark.createDataFrame(ticks, "t bigint, active boolean").select(
        F.timestamp_micros(F.col("t") * 1_000_000).cast("timestamp_ntz").alias("ts"), "active", F.lit("A").alias("alertname"),
        F.lit("warning").alias("severity"), F.lit("n").alias("node"), F.lit("s").alias("series"), F.lit(120).alias("for_s"))
    for chunk in (15_000_000, 100_000_000):
        got = sorted((r.pending_at.minute * 60 + r.pending_at.second, r.state) for r in al.hold_for(df, 15, chunk_us=chunk).collect())
        assert got == [(0, "pending"), (120, "firing"), (315, "pending")]


def test_rule_table():
    assert len(al.ALERT_RULES) == 22 and len({r.name for r in al.ALERT_RULES}) == 22
    assert {r.severity for r in al.ALERT_RULES} == {"critical", "warning"}


def test_connector_status(spark):
    rows = [("c", "a", "RUNNING", [("RUNNING",)]), ("c", "b", "RUNNING", [("RUNNING",), ("FAILED",)]), ("c", "d", "PAUSED", []),
            ("c", "e", None, [("RUNNING",)]), ("c", "f", "RUNNING", [(None,)])]
    df = spark.createDataFrame(rows, "cluster string, connector string, state string, tasks array<struct<state: string>>")
    assert {r.connector: r.status for r in tm.connector_status(df).collect()} == {
        "a": "PASS", "b": "WARN", "d": "WARN", "e": "FAIL", "f": "WARN"}


def test_value_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, 1), (2, "x", None)], "k int, s string, n int")
    b = spark.createDataFrame([(1, None, 2), (2, None, None)], "k int, s string, n int")
    assert {r.column: r.mismatches for r in reconcile.value_diff(a, b, ["k"]).collect()} == {"s": 1, "n": 1}


def test_checksum_finds_a_swapped_value(spark):
    a = spark.createDataFrame([(i, i % 5) for i in range(100)], "k int, v int")
    b = a.withColumn("v", F.when(F.col("k") == 7, 99).otherwise(F.col("v")))
    assert reconcile.checksum_diff(a, b, ["k"], 8).filter("NOT equal").count() == 1
    assert reconcile.checksum_diff(a, a, ["k"], 8).filter("NOT equal").count() == 0


def test_orphans_ignore_null_references(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 99)], "id int, ref int")
    parent = spark.createDataFrame([(10,), (11,)], "pid int")
    assert rows_of(reconcile.fk_orphans(child, parent, "ref", "pid").select("id")) == [(3,), (4,)]


def test_key_spec_with_database_counts_for_conflicts(spark):
    cfg = spark.createDataFrame([("d", " ", "", "shop.dbo.t1:a,b;dbo.t2:c")],
                                "db_id string, include_list string, exclude_list string, key_spec string")
    bare = spark.createDataFrame([("d", "dbo", "t1"), ("d", "dbo", "t2"), ("d", "dbo", "t3")], "db_id string, schema string, table string")
    assert rows_of(audit.config_conflicts(cfg, bare)) == [("missing_key_columns", "d", "dbo.t3")]


def test_saved_table_comes_back_in_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "k bigint, v string")
    tables.save_table(df, str(tmp_path / "t"), ["k"], 8)
    back = tables.load_table(spark, str(tmp_path / "t"))
    assert rows_of(back.drop("bucket")) == rows_of(df)
    assert back.select("bucket").distinct().count() > 1


def test_ensure_table_is_repeatable(spark):
    schema = StructType.fromDDL("k bigint, v string")
    name = "rowtide_ensure_table_test"
    try:
        for _ in range(2):
            assert tables.ensure_table(spark, name, schema).columns == ["k", "v"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_count_parity_approximate_form(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(80)], "k int, v int")
    row = reconcile.count_parity([("t", df, df, ["k"])], approx=True).first()
    assert row.status == "PASS" and abs(row.source_keys - 40) <= 4


def test_profiles():
    fast, bulk = Profile.streaming(), Profile.snapshot()
    assert (bulk.bootstrap_mode, fast.bootstrap_mode) == ("initial", "no_data")
    assert bulk.max_batch_size == 4096 and fast.max_batch_size == 256
    assert bulk.trigger(False) == {"availableNow": True} and fast.trigger(True) == {"processingTime": "50 milliseconds"}
