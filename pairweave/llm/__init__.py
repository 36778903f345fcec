"""Operators for large training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

#: Modules that register queries; each has QUERIES and ORACLE.
_MODULES = ("survivors", "similar_groups", "chains", "ledger", "top_items", "leaks", "mixing", "spam")


def _loaded():
    return [importlib.import_module(f"{__name__}.{name}") for name in _MODULES]


def queries() -> dict:
    return {name: f for module in _loaded() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _loaded() for name, sql in module.ORACLE.items()}
