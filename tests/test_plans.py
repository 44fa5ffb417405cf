"""Shape of the physical plans."""

from __future__ import annotations

import os
import re

import pytest

from rowtide import plans

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
QUERIES = plans.queries()
WRITES_FIRST = {
    "tumbling", "sliding", "session_stream", "interval_join_stream", "stream_dedupe", "enrich_stream", "pass_through",
    "stream_upsert", "stream_upsert_apply", "stream_hold", "event_lag_stream", "bucketed_table", "inhibit", "notifications",
}


def plan(spark, name):
    return QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - WRITES_FIRST))
def test_no_cross_joins_and_no_global_windows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    lines = [re.sub(r"^[\s:+\-|*()\d]*", "", line) for line in text.splitlines()]
    for i, line in enumerate(lines):
        if line.startswith("Window "):
            below = next((x for x in lines[i + 1:] if x.startswith("Exchange")), "")
            assert not below.startswith("Exchange SinglePartition"), line


@pytest.mark.parametrize("name", ["upsert_drop_deletes", "upsert_apply_deletes", "net_changes"])
def test_one_shuffle_with_a_partial_step_before_it(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in text.split("Exchange hashpartitioning", 1)[1]


@pytest.mark.parametrize("name", ["unwrap_drop", "mask_pii", "cast_or_dlq", "route_topics", "check_lengths", "decode_versions"])
def test_transforms_do_not_shuffle_rows(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == (1 if name == "route_topics" else 0)


def test_tail_keeps_n_rows_per_task_before_the_shuffle(spark):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, "tail_topic"))


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "missing_extra")
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
    assert "PushedFilters: [" in plan(spark, "propagation")
