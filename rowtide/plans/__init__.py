"""Queries over the benchmark tables. Each module has ``QUERIES`` (name -> function of session and
folder) and ``ORACLE`` (name -> the same result as SQL on the same tables)."""
from __future__ import annotations

from importlib import import_module

MODULES = ["capture", "transform", "merge", "reconciling", "fleet", "metrics", "alerting", "streams"]


def _collect(attr: str) -> dict:
    out = {}
    for name in MODULES:
        part = getattr(import_module(f"rowtide.plans.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
