"""Metric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowtide.functions.names import matches_whole


def series_key(labels: Column) -> Column:
    """One string per label set, independent of the order the labels came in."""
    pairs = F.transform(
        F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(pairs, ",")


def label(labels: Column, name: str) -> Column:
    """Label value; a label that is not there reads as the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def matcher(labels: Column, eq=None, regex=None, not_regex=None) -> Column:
    """Conjunction of ``=``, ``=~`` and ``!~`` matchers (regexes match the whole value)."""
    cond = F.lit(True)
    for k, v in (eq or {}).items():
        cond = cond & (label(labels, k) == v)
    for k, p in (regex or {}).items():
        cond = cond & matches_whole(label(labels, k), p)
    for k, p in (not_regex or {}).items():
        cond = cond & ~matches_whole(label(labels, k), p)
    return cond
