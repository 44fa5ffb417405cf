"""Log positions and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["bytes", "kB", "MB", "GB", "TB", "PB"]


def lsn_bytes(pos: Column) -> Column:
    """Byte position of an ``X/Y`` hex pair: X * 2^32 + Y."""
    hi = F.conv(F.split_part(pos, F.lit("/"), F.lit(1)), 16, 10).cast("bigint")
    lo = F.conv(F.split_part(pos, F.lit("/"), F.lit(2)), 16, 10).cast("bigint")
    return hi * F.lit(4294967296).cast("bigint") + lo


def size_text(nbytes: Column) -> Column:
    """Readable size in steps of 1024, whole units, rounded down."""
    out = F.when(nbytes < 1024, F.concat(nbytes.cast("string"), F.lit(" " + UNITS[0])))
    for i, unit in enumerate(UNITS[1:], start=1):
        scaled = F.floor(nbytes / F.lit(float(1024**i))).cast("bigint").cast("string")
        text = F.concat(scaled, F.lit(" " + unit))
        last = i == len(UNITS) - 1
        out = out.otherwise(text) if last else out.when(nbytes < 1024 ** (i + 1), text)
    return out
