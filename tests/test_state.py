"""The upsert inside the stream against the batch upsert."""

from __future__ import annotations

import pytest

from helpers import event, events, rows_of
from rowtide import streaming as st
from rowtide.operators import apply as ap
from rowtide.streaming.state import keyed_state, stream_upsert_state
from test_apply import KEY, history


@pytest.mark.parametrize("deletes", ["drop", "apply"])
def test_state_in_the_stream_equals_batch_upsert(spark, tmp_path, deletes):
    """Several batches, shuffled, with late and repeated events, after a restart and from a snapshot."""
    rows = history(5)
    schema = events(spark, []).schema
    table = spark.createDataFrame([(i, f"snap{i}", i) for i in range(8)], "id bigint, name string, amount bigint")
    snapshot = ap.as_state(table, lsn=5)
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    for part in (rows[100:], rows[:60], rows[50:120] + rows[150:], rows[:10]):
        events(spark, part).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).parquet(log)
        with keyed_state(spark):
            st.update_sink(stream_upsert_state(stream, KEY, deletes, snapshot), out, checkpoint)
    changed = st.latest_epoch(spark, out, KEY)
    kept = snapshot.join(changed, KEY, "left_anti").select(*changed.columns)
    want = ap.live(ap.upsert(snapshot, events(spark, rows), KEY, deletes))
    assert rows_of(ap.live(changed.unionByName(kept))) == rows_of(want)


def test_older_events_give_nothing_out(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    for n, row in enumerate((event("c", 1, 20, "new", 1), event("u", 1, 10, "old", 1), event("c", 1, 20, "new", 1))):
        events(spark, [row]).coalesce(1).write.mode("append").parquet(log)
        with keyed_state(spark):
            st.update_sink(stream_upsert_state(spark.readStream.schema(events(spark, []).schema).parquet(log), KEY), out, checkpoint)
    assert [(r.epoch, r.name) for r in spark.read.parquet(out).collect()] == [(0, "new")]


def test_the_state_is_a_row_for_each_bucket_of_keys(spark, tmp_path):
    """Three thousand keys, null among them, are four rows of the state and not three thousand."""
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    table = spark.range(3000).selectExpr("id", "concat('snap', id) AS name", "id AS amount")
    snapshot = ap.as_state(table, lsn=5)
    rows = [event("u", k, 9, f"n{k}", k) for k in [None, *range(0, 4000, 3)]] + [event("u", 6, 4, "old", 0)]
    events(spark, rows).write.parquet(log)
    with keyed_state(spark):
        stream = spark.readStream.schema(events(spark, []).schema).parquet(log)
        query = st.update_sink(stream_upsert_state(stream, KEY, "apply", snapshot, buckets=4), out, checkpoint)
    got = st.latest_epoch(spark, out, KEY)
    assert sorted(((r.id, r.name) for r in got.collect()), key=str) == sorted([(k, f"n{k}") for k in [None, *range(0, 4000, 3)]], key=str)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_keys_are_forgotten_one_by_one():
    """Of two keys of a bucket the one that has not changed for the time to live is forgotten."""
    import pandas as pd

    from rowtide.streaming.state import _Newest

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class At:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = lambda: ms

    def change(key, lsn):
        return iter([pd.DataFrame({"bucket": [0], "key": [key], "v0": [lsn], "v1": [0], "v2": [0], "v3": [0], "image": [f"{key}{lsn}"]})])

    state = _Newest(100)
    state.newest = Held()
    told = [[*next(state.handleInputRows(0, change(k, lsn), At(ms)))["image"]] for k, lsn, ms in (
        ("a", 5, 0), ("b", 5, 60), ("a", 4, 90), ("a", 4, 120), ("b", 4, 130), ("b", 4, 170))]
    assert told == [["a5"], ["b5"], [], ["a4"], [], ["b4"]]
