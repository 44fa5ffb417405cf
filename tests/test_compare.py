"""Digest trees, violation intervals, offset range sets and schema versions on hand-built cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from rowtide.operators import digests as dg
from rowtide.operators import ranges as rg
from rowtide.operators import reconcile as rc
from rowtide.sources.changes import diff_capture

SCHEMA = "id bigint, name string, n int"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def brute_diff(a, b):
    left, right = {r[0]: r[1:] for r in a}, {r[0]: r[1:] for r in b}
    out = [(k, "missing", None) for k in left.keys() - right.keys()] + [(k, "extra", None) for k in right.keys() - left.keys()]
    for k in left.keys() & right.keys():
        names = [c for c, x, y in zip(("name", "n"), left[k], right[k]) if x != y]
        out += [(k, "changed", names)] if names else []
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf_bits", [0, 3, 12, 62])
def test_tree_diff_like_brute_force(spark, leaf_bits):
    rng = random.Random(leaf_bits)
    ids = [*range(-40, 400), 2**63 - 1, -(2**63), None]
    a = [(i, rng.choice(["x", "y", None]), rng.choice([1, None])) for i in ids]
    b = [(i, n if rng.random() < 0.97 else "z", v) for i, n, v in a if rng.random() < 0.97] + [(1000, "e", 1)]
    got = dg.tree_diff(table(spark, a), table(spark, b), ["id"], leaf_bits).collect()
    assert sorted(((r.id, r.status, r.columns) for r in got), key=str) == brute_diff(a, b)


def test_tree_diff_of_equal_empty_and_swapped_tables(spark):
    a = [(i, "x", i) for i in range(50)]
    some, none = table(spark, a), table(spark, [])
    assert dg.tree_diff(some, some.repartition(7), ["id"], 2).collect() == [] == dg.tree_diff(none, none, ["id"]).collect()
    assert dg.tree_diff(some, none, ["id"]).count() == 50 == dg.tree_diff(none, some, ["id"]).where("status = 'extra'").count()
    # a value that moves to another column is a difference
    left, right = (spark.createDataFrame([r], "id bigint, a string, b string") for r in ((1, "v", None), (1, None, "v")))
    assert [r.columns for r in dg.tree_diff(left, right, ["id"]).collect()] == [["a", "b"]]


def test_tree_diff_with_text_keys_and_new_columns(spark):
    a = table(spark, [(f"k{i}", i) for i in range(200)], "id string, n int")
    b = a.where("n <> 5").withColumn("extra", F.when(F.col("n") == 7, 1))
    got = sorted((r.id, r.status, r.columns) for r in dg.tree_diff(a, b, ["id"]).collect())
    assert got == [("k5", "missing", None), ("k7", "changed", ["extra"])]


def test_equal_leaves_are_not_read_again(spark, tmp_path):
    """Rows of leaves that are alike raise an error if they are read after the digests are made."""
    spark.range(0, 4096).selectExpr("id", "id % 7 AS n").coalesce(1).write.option("parquet.block.size", 8192).parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    b = a.withColumn("n", F.when(F.col("id") == 100, 99).otherwise(F.col("n")))
    height = -(-60 // dg.FAN_BITS)
    found = dg.unequal_leaves(*[dg.tree(dg.leaves(x, ["id"], ["id", "n"], 4), height) for x in (a, b)], height)
    assert [r.node for r in found.collect()] == [100 >> 4]
    rows = dg._within(a, ["id"], found, 4)
    assert sorted(r.id for r in rows.collect()) == list(range(96, 112))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,96)" in plan and "LessThanOrEqual(id,111)" in plan


def test_descent_meets_only_children_of_unequal_nodes(spark):
    made = [dg.tree(spark.createDataFrame([(i, 1, 5 if i != bad else 6) for i in range(5000)], "node bigint, rows bigint, digest bigint"), 2) for bad in (None, 4321)]
    assert [r.node for r in dg.unequal_leaves(*made, 2).collect()] == [4321]
    assert dg.unequal_leaves(made[0], made[0], 2).collect() == []


def test_diff_capture_sees_new_and_lost_columns(spark):
    old = table(spark, [(1, "a", 1), (2, "b", None), (3, "c", 3)])
    new = table(spark, [(1, "a", "x"), (2, "b", None), (3, "c", None)], "id bigint, name string, note string")
    for bits in (None, 1):
        got = diff_capture(old, new, "p.db.dbo.t", ["id"], 1, leaf_bits=bits)
        assert got.schema["after"].dataType.names == ["id", "name", "n", "note"]
        assert rows_of(got.select("key.id", "op", "after.note"), ["id", "op", "note"]) == [(1, "u", "x"), (3, "u", None)]


def brute_violations(child, parent, until):
    """Instant by instant."""
    def at(log, t, key):
        past = [r for r in log if r["key"] == key and r["at"] <= t]
        last = max(past, key=lambda r: (r["at"], r["seq"])) if past else None
        return None if last is None or last["gone"] else last

    out = []
    for key in sorted({r["key"] for r in child}):
        run = None
        for t in range(until + 2):
            row = at(child, t, key) if t <= until else None
            ref = row and row["ref"]
            bare = ref is not None and at(parent, t, ref) is None
            if run and (not bare or ref != run[0]):
                end = None if t > until else t
                state = "open" if end is None else "healed" if ref == run[0] else "withdrawn"
                out.append((key, run[0], run[1], end, state))
                run = None
            if bare and run is None:
                run = (ref, t)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, chunk", [(1, 7), (2, 100), (3, 13)])
def test_violation_intervals_like_brute_force(spark, seed, chunk):
    rng = random.Random(seed)
    until = 60
    child = [{"key": rng.randint(0, 9), "ref": rng.choice([None, *range(6)]), "at": rng.randint(0, 70), "gone": rng.random() < 0.2} for _ in range(60)]
    parent = [{"key": rng.randint(0, 5), "at": rng.randint(0, 70), "gone": rng.random() < 0.4} for _ in range(25)]
    for log in (child, parent):
        for i, r in enumerate(log):
            r["seq"] = i
    c = spark.createDataFrame([(r["key"], r["ref"], r["at"], r["seq"], r["gone"]) for r in child], "id bigint, ref bigint, at bigint, seq int, gone boolean")
    p = spark.createDataFrame([(r["key"], r["at"], r["seq"], r["gone"]) for r in parent], "ref bigint, at bigint, seq int, gone boolean")
    got = rc.fk_violation_intervals(c, p, ["id"], until, chunk)
    assert sorted(((r.id, r.ref, r.since, r.till, r.state) for r in got.collect()), key=str) == brute_violations(child, parent, until)
    assert rc.fk_violation_intervals(c.where("false"), p, ["id"], until).collect() == []


@pytest.mark.parametrize("busy", [0, 12])
def test_violation_intervals_of_busy_keys(spark, busy):
    """All keys cut along time, and some of them, with a reference of another type on each side."""
    rng = random.Random(busy)
    until = 60
    child = [{"key": rng.choice([1, 1, *range(10)]), "ref": rng.choice([None, 1, 1, *range(6)]), "at": rng.randint(0, 70), "gone": rng.random() < 0.2} for _ in range(60)]
    parent = [{"key": rng.choice([2, 2, *range(6)]), "at": rng.randint(0, 70), "gone": rng.random() < 0.4} for _ in range(25)]
    for log in (child, parent):
        for i, r in enumerate(log):
            r["seq"] = i
    c = spark.createDataFrame([(r["key"], r["ref"], r["at"], r["seq"], r["gone"]) for r in child], "id bigint, ref bigint, at bigint, seq int, gone boolean")
    p = spark.createDataFrame([(r["key"], r["at"], r["seq"], r["gone"]) for r in parent], "ref int, at bigint, seq int, gone boolean")
    got = rc.fk_violation_intervals(c, p, ["id"], until, 7, busy)
    assert sorted(((r.id, r.ref, r.since, r.till, r.state) for r in got.collect()), key=str) == brute_violations(child, parent, until)


def test_violation_intervals_are_not_cut_without_need(spark):
    """An interval of a thousand chunks stays one row."""
    c = spark.createDataFrame([(1, 5, 0, 0, False)], "id bigint, ref bigint, at bigint, seq int, gone boolean")
    p = spark.createDataFrame([(5, 900, 0, False)], "ref bigint, at bigint, seq int, gone boolean")
    got = rc.fk_violation_intervals(c, p, ["id"], 1000, 1)
    assert [tuple(r) for r in got.collect()] == [(1, 5, 0, 900, "healed")]
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()


def ranges_of(df):
    return sorted((r.partition, r.start, r.end) for r in df.collect())


@pytest.mark.parametrize("chunk", [4, 1 << 18])
def test_range_sets(spark, chunk):
    rng = random.Random(chunk)
    seen = {p: {rng.randint(0, 80) for _ in range(50)} for p in range(3)}
    rows = [("t", p, o) for p, os in seen.items() for o in os for _ in range(rng.randint(1, 3))] + [("t", None, 1), ("t", 1, None)]
    rng.shuffle(rows)
    ev = spark.createDataFrame(rows, "topic string, partition int, offset bigint")
    found = rg.offset_ranges(ev, chunk)
    held = {(r.partition, o) for r in found.collect() for o in range(r.start, r.end + 1)}
    assert held == {(p, o) for p, os in seen.items() for o in os}
    assert all((p, e + 1) not in held for p, _, e in ranges_of(found))
    gaps = {(r.partition, o) for r in rg.offset_gaps(found, chunk=chunk).collect() for o in range(r.start, r.end + 1)}
    assert gaps == {(p, o) for p, os in seen.items() for o in range(min(os), max(os)) if o not in os}
    parts = [rg.offset_ranges(ev.where(f"offset % 3 = {k}"), chunk) for k in range(3)]
    assert ranges_of(rg.merge_ranges(*parts, chunk=chunk)) == ranges_of(found)
    left = {(r.partition, o) for r in rg.subtract_ranges(found, parts[0], chunk).collect() for o in range(r.start, r.end + 1)}
    assert left == {(p, o) for p, o in held if o % 3}
    fresh = rg.dedupe_by_ranges(ev, parts[0], chunk).collect()
    assert sorted((r.partition, r.offset) for r in fresh if r.offset is not None and r.partition is not None) == sorted(left) and len(fresh) == len(left) + 2


def test_gaps_from_a_known_beginning_and_empty_sets(spark):
    ev = spark.createDataFrame([("t", 0, 5), ("t", 0, 7)], "topic string, partition int, offset bigint")
    begin = spark.createDataFrame([("t", 0, 2), ("t", 1, 0)], "topic string, partition int, start bigint")
    got = rg.offset_gaps(rg.offset_ranges(ev), begin)
    assert sorted((r.partition, r.start, r.end, r.lost) for r in got.collect()) == [(0, 2, 4, 3), (0, 6, 6, 1)]
    none = rg.offset_ranges(ev.where("false"))
    assert none.collect() == [] == rg.offset_gaps(none).collect() and rg.dedupe_by_ranges(ev, none).count() == 2


def test_compatibility_with_the_version_registered_before(spark):
    rows = [("s", 1, "id", "int", False, False), ("s", 3, "id", "string", False, False), ("s", 3, "x", "int", True, False), ("u", 2, "id", "int", False, False)]
    registry = spark.createDataFrame(rows, "subject string, version int, name string, type string, nullable boolean, has_default boolean")
    got = rc.schema_compat(registry)
    assert rows_of(got.select("subject", "version", "name", "verdict"), ["subject", "version", "name", "verdict"]) == [("s", 3, "id", "type_changed"), ("s", 3, "x", "added_optional")]
