"""Seconds per headline query, warm, median of three; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads, BENCH_QUERIES a
comma-separated choice of queries (``all`` for every registered one).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowtide.session import local_session  # noqa: E402

HEADLINE = [
    "upsert_drop_deletes", "upsert_apply_deletes", "net_changes", "diff_capture", "value_diff", "fk_orphans", "dlq_split",
    "rate_5m", "hold_for", "session", "interval_join", "latency_percentiles", "bucket_checksum", "retention",
    "fanout_state", "stream_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench")

    from rowtide import plans

    known = plans.queries()
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(known) if chosen == "all" else chosen.split(",")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rates = {}
    if "stream_upsert" in seconds:
        from rowtide.plans.logs import orders_log

        events = orders_log(spark, sf_dir).count()
        rates["stream_upsert_events_per_s"] = round(events / seconds["stream_upsert"])
    scanned = {"value_diff": "orders", "fk_orphans": "lineitem", "rate_5m": "events", "session": "events", "latency_percentiles": "events"}
    for name, table in scanned.items():
        if name in seconds:
            rates[f"{name}_mb_per_s"] = round(os.path.getsize(f"{sf_dir}/{table}.parquet") / 1e6 / seconds[name], 2)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
