"""The operators on Structured Streaming."""
from rowtide.streaming.jobs import (  # noqa: F401
    dedupe_stream, enrich, interval_join_stream, late_rows, latest_epoch, on_time_rows, run_now, session_agg, split_late,
    stream_hold, stream_upsert, update_sink, window_agg,
)
