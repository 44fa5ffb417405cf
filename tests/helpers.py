"""Small builders shared by the tests."""

from __future__ import annotations

import math

EVENT = (
    "topic string, partition int, offset bigint, ts timestamp_ntz, key struct<id: bigint>, op string, "
    "before struct<id: bigint, name: string, amount: bigint>, after struct<id: bigint, name: string, amount: bigint>, "
    "source struct<db: string, schema: string, table: string, lsn: bigint, seq: bigint, ts: timestamp_ntz, "
    "snapshot: boolean>, headers map<string, string>, schema_version int"
)


def event(op, key, lsn, name=None, amount=None, seq=0, offset=None, partition=0, schema_version=1, headers=None):
    after = None if op in ("d", None) else (key, name, amount)
    return (
        "p.db.dbo.t", partition, lsn if offset is None else offset, None, (key,), op, None, after,
        ("db", "dbo", "t", lsn, seq, None, False), headers, schema_version,
    )


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df, cols=None):
    """Rows as sorted tuples, columns in name order unless given."""
    cols = cols or sorted(df.columns)
    out = [tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
