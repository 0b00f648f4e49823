"""Registered queries, grouped by subject."""

from __future__ import annotations

import importlib

from latewise.catalog.registry import QUERIES, SQL, Query

_MODULES = ["tables", "stats", "evaluation", "modelling", "explaining"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"latewise.catalog.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
