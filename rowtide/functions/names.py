"""Topic and table names.

A topic is ``prefix.db.schema.table`` or ``prefix.schema.table``; matching a
regex against a topic always means matching the whole name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic classes by name prefix.
TOPIC_CLASSES = [
    ("dlq", r"^dlq-"),
    ("history", r"^_schema-history-"),
    ("internal", r"^(__|_schemas$|connect-)"),
    ("cdc", r"^(sqlserver|aurora)\."),
]


def whole(pattern: str) -> str:
    """Anchor a regex at both ends."""
    return f"^(?:{pattern})$"


def matches_whole(col: Column, pattern: str) -> Column:
    return col.rlike(whole(pattern))


def topic_parts(topic: Column) -> Column:
    """struct(prefix, db, schema, table); ``db`` is null for three-part names."""
    parts = F.split(topic, r"\.", 4)
    n = F.size(parts)
    return F.struct(
        F.get(parts, F.lit(0)).alias("prefix"),
        F.when(n == 4, F.get(parts, F.lit(1))).alias("db"),
        F.when(n == 4, F.get(parts, F.lit(2))).when(n == 3, F.get(parts, F.lit(1))).alias("schema"),
        F.when(n == 4, F.get(parts, F.lit(3))).when(n == 3, F.get(parts, F.lit(2))).alias("table"),
    )


def routed_name(topic: Column, pattern: str, replacement: str = "$1") -> Column:
    """Name after regex routing; a topic the pattern does not match keeps its name.

    A replacement that uses ``$1`` needs a group in the pattern, otherwise every
    record would go to the empty name; that is refused here.
    """
    groups = re.compile(pattern).groups
    wanted = [int(g) for g in re.findall(r"\$(\d+)", replacement)]
    if wanted and max(wanted) > groups:
        raise ValueError(f"pattern {pattern!r} has {groups} group(s), replacement {replacement!r} needs {max(wanted)}")
    anchored = whole(pattern)
    return F.when(topic.rlike(anchored), F.regexp_replace(topic, anchored, replacement)).otherwise(topic)


def topic_class(topic: Column, classes=TOPIC_CLASSES) -> Column:
    out = None
    for label, pattern in classes:
        cond = topic.rlike(pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("other")
