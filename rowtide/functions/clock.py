"""Time as integer microseconds, the unit all window frames here are written in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(n: float) -> int:
    return int(round(n * SECOND))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")
