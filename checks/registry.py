"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("flagship", "q_sources", "q_windows", "q_series", "q_metrics", "q_models", "q_streams")


def _entries() -> dict:
    found = {}
    for name in MODULES:
        found.update(importlib.import_module(f"checks.{name}").ENTRIES)
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
