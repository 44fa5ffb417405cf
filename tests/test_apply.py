from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import event, events, rows_of
from rowtide.operators import apply as ap
from rowtide.operators import transforms as tr
from rowtide.sources import changes as ch
from rowtide.sources import versions
from rowtide.sources.versions import read_state

KEY = ["id"]


def state_of(spark, rows, deletes="apply"):
    return rows_of(ap.live(ap.upsert(None, events(spark, rows), KEY, deletes)))


def history(seed, keys=20, steps=200):
    rng, rows, alive = random.Random(seed), [], set()
    for lsn in range(1, steps + 1):
        k = rng.randrange(keys)
        if k in alive and rng.random() < 0.25:
            rows.append(event("d", k, lsn))
            rows.append(event(None, k, lsn, offset=lsn + 100_000))
            alive.discard(k)
        else:
            rows.append(event("u" if k in alive else "c", k, lsn, f"n{lsn}", lsn))
            alive.add(k)
    return rows


def replayed(rows, deletes):
    table = {}
    for r in sorted(rows, key=lambda r: (r[8][3], r[2])):
        op, key, after = r[5], r[4][0], r[7]
        if op == "d" and deletes == "apply":
            table.pop(key, None)
        elif op in ("c", "u", "r"):
            table[key] = after
    return sorted(((a[2], a[0], a[1]) for a in table.values()), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("deletes", ["drop", "apply"])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_sequential_replay(spark, deletes, seed):
    rows = history(seed)
    assert state_of(spark, rows, deletes) == replayed(rows, deletes)


def test_order_and_redelivery_do_not_matter(spark):
    rows = history(3)
    mixed = rows + rows[::3]
    random.Random(0).shuffle(mixed)
    assert state_of(spark, mixed) == state_of(spark, rows)


def test_any_split_into_batches_gives_the_same_state(spark):
    rows = history(4)
    whole = state_of(spark, rows)
    for cut in (1, 70, 199):
        first = ap.upsert(None, events(spark, rows[cut:]), KEY, "apply")
        second = ap.upsert(first, events(spark, rows[:cut]), KEY, "apply")
        assert rows_of(ap.live(second)) == whole
        again = ap.upsert(second, events(spark, rows), KEY, "apply")
        assert rows_of(ap.live(again)) == whole


def test_late_update_does_not_revive_a_deleted_row(spark):
    gone = ap.upsert(None, events(spark, [event("c", 1, 1, "a", 1), event("d", 1, 5)]), KEY, "apply")
    after = ap.upsert(gone, events(spark, [event("u", 1, 3, "late", 3)]), KEY, "apply")
    assert rows_of(ap.live(after)) == []
    back = ap.upsert(after, events(spark, [event("c", 1, 6, "new", 6)]), KEY, "apply")
    assert rows_of(ap.live(back)) == [(6, 1, "new")]


def test_tie_on_lsn_is_decided_by_sequence_then_offset(spark):
    rows = [event("u", 1, 5, "low", 1, seq=1, offset=9), event("u", 1, 5, "high", 2, seq=2, offset=1),
            event("u", 2, 5, "first", 1, offset=1), event("u", 2, 5, "second", 2, offset=2)]
    assert state_of(spark, rows) == [(2, 1, "high"), (2, 2, "second")]


def test_empty_input(spark):
    assert state_of(spark, []) == []
    assert rows_of(ap.net_changes(events(spark, []), KEY, 0, 9)) == []


def test_absent_column_keeps_value_and_null_overwrites(spark):
    rows = spark.createDataFrame(
        [(1, "old", 7, (1,), False, 2), (1, "newer", None, (2,), False, 1),
         (2, "x", 7, (1,), False, 2), (2, "x", None, (2,), False, 2),
         (3, "x", 7, (1,), False, 2), (3, None, None, (2,), True, 1), (3, "back", None, (3,), False, 1)],
        "id bigint, name string, amount bigint, _version struct<lsn: bigint>, _deleted boolean, _schema_version int")
    got = ap.live(ap.latest(rows, KEY, {"amount": 2}))
    assert rows_of(got, ["id", "name", "amount"]) == [(1, "newer", 7), (2, "x", None), (3, "back", None)]


def test_new_column_is_added_and_changed_type_refused(spark):
    state = ap.as_state(spark.createDataFrame([(1, "a")], "id bigint, name string"), lsn=0)
    got = ap.live(ap.upsert(state, events(spark, [event("c", 2, 3, "b", 5)]), KEY))
    assert rows_of(got, ["id", "name", "amount"]) == [(1, "a", None), (2, "b", 5)]
    wrong = ap.as_state(spark.createDataFrame([(1, 5)], "id bigint, name int"), lsn=0)
    with pytest.raises(TypeError):
        ap.upsert(wrong, events(spark, [event("c", 2, 3, "b", 5)]), KEY)


@pytest.mark.parametrize("ops,want", [
    (["c", "d"], []), (["c", "u"], ["c"]), (["d", "c"], ["u"]), (["u", "d"], ["d"]), (["u"], ["u"]),
    (["c", "d", "c"], ["c"]), (["d"], ["d"]),
])
def test_net_change(spark, ops, want):
    rows = [event(op, 1, i + 1, "n", i) for i, op in enumerate(ops)]
    assert [r.op for r in ap.net_changes(events(spark, rows), KEY, 0, 99).collect()] == want


def test_diff_capture_replays_to_the_new_table(spark):
    schema = "id bigint, name string, amount bigint"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (4, None, 4)], schema)
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, None, 4), (5, "e", 5)], schema)
    diff = ch.diff_capture(old, new, "p.db.dbo.t", KEY, 9)
    assert sorted((r.key.id, r.op) for r in diff.collect()) == [(2, "u"), (3, "d"), (5, "c")]
    got = ap.live(ap.upsert(ap.as_state(old, lsn=0), diff, KEY, "apply"))
    assert rows_of(got) == rows_of(new)


def test_unwrap_modes(spark):
    ev = events(spark, [event("c", 1, 1, "a", 1), event("d", 1, 2), event(None, 1, 3)])
    assert [r.op for r in tr.unwrap(ev).collect()] == ["c"]
    assert sorted(r.op for r in tr.unwrap(ev, "keep").collect()) == ["c", "d"]
    with pytest.raises(ValueError):
        tr.unwrap(ev, "rewrite")


def test_both_sites_agree(spark):
    a = events(spark, [event("u", 1, 5, "a5", 1), event("u", 2, 6, "a6", 2)])
    b = events(spark, [event("u", 1, 7, "b7", 3), event("d", 2, 4)])
    base = ap.as_state(spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id bigint, name string, amount bigint"), lsn=0)
    left, right = ap.bidirectional(base, base, a, b, KEY, "apply")
    assert rows_of(ap.live(left)) == rows_of(ap.live(right)) == [(2, 2, "a6"), (3, 1, "b7")]


def test_bootstrap_modes(spark):
    snap, log = events(spark, [event("r", 1, 10, "s", 0)]), events(spark, [event("u", 1, 5, "old", 1), event("u", 1, 11, "new", 2)])
    assert ch.bootstrap(snap, log, "initial", 10).count() == 2
    assert ch.bootstrap(snap, log, "initial", 10, has_offsets=True).count() == 2
    assert {r.op for r in ch.bootstrap(snap, log, "no_data").collect()} == {"u"}
    with pytest.raises(ValueError):
        ch.bootstrap(snap, log, "sometimes")


def test_unique_conflicts_keep_the_smallest_key_and_ignore_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "id bigint, email string")
    assert rows_of(ap.unique_conflicts(df, ["id"], ["email"]).select("id")) == [(2,)]


def test_merge_batch_is_repeatable_and_recovers(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    rows = history(6)
    for batch, part in enumerate((rows[:120], rows[120:])):
        for _ in range(2):
            ap.merge_batch(spark, path, events(spark, part), KEY, 4, batch, staging, "apply")
    assert rows_of(ap.live(read_state(spark, path))) == state_of(spark, rows)


def test_a_batch_that_comes_again_after_another_writer(spark, tmp_path):
    """Writer A, writer B, then A's batch once more: the newer row stays."""
    path = str(tmp_path / "t")
    old, new = [event("c", 1, 10, "old", 1)], [event("u", 1, 20, "new", 1), event("c", 2, 21, "b", 1)]
    for rows, staging in ((old, "a"), (new, "b"), (old, "a")):
        ap.merge_batch(spark, path, events(spark, rows), KEY, 2, 0, str(tmp_path / staging))
    assert {r.id: r.name for r in ap.live(read_state(spark, path)).collect()} == {1: "new", 2: "b"}


def test_a_reader_sees_one_version(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    ap.merge_batch(spark, path, events(spark, [event("c", i, 10, "one", 1) for i in range(20)]), KEY, 4, 0, staging)
    before = read_state(spark, path)
    ap.merge_batch(spark, path, events(spark, [event("u", i, 20, "two", 1) for i in range(20)]), KEY, 4, 1, staging)
    assert {r.name for r in before.collect()} == {"one"} and {r.name for r in read_state(spark, path).collect()} == {"two"}


def test_the_slower_of_two_writers_merges_again(spark, tmp_path, monkeypatch):
    """Another writer publishes between this one's read and its publication."""
    path, staging, publish = str(tmp_path / "t"), str(tmp_path / "s"), versions.publish
    ap.merge_batch(spark, path, events(spark, [event("c", 1, 1, "a", 1)]), KEY, 1, 0, staging)

    def late(*args):
        monkeypatch.setattr(versions, "publish", publish)
        ap.merge_batch(spark, path, events(spark, [event("c", 2, 2, "b", 1)]), KEY, 1, 7, staging)
        return publish(*args)

    monkeypatch.setattr(versions, "publish", late)
    ap.merge_batch(spark, path, events(spark, [event("c", 3, 3, "c", 1)]), KEY, 1, 1, staging)
    assert sorted(r.id for r in read_state(spark, path).collect()) == [1, 2, 3]


def test_large_buckets_are_written_in_parts_and_old_folders_go(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    for batch in range(6):
        rows = [event("c", i, batch + 1, f"{i}-{batch}" * 20, i) for i in range(300)]
        ap.merge_batch(spark, path, events(spark, rows), KEY, 1, batch, staging, bucket_bytes=2_000)
    now = versions.current(spark, path)
    assert now.number == 6 and len(read_state(spark, path).inputFiles()) > 1
    assert len(list((tmp_path / "t").glob("data-*"))) == versions.KEPT + 1 and not list((tmp_path / "s").iterdir())
    ap.merge_batch(spark, path, events(spark, []), KEY, 1, 9, staging)
    assert versions.current(spark, path).number == 6
    with pytest.raises(FileNotFoundError):
        read_state(spark, str(tmp_path / "none"))
