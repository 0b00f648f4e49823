"""Operators for preparing training text at scale, and their registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latewise.llm.registry import QUERIES, SQL

_MODULES = [
    "bpe", "chat", "collocations", "decontaminate", "line_dedup", "lm", "minhash", "pii", "pipeline", "prefix_trie", "quality",
    "sharding", "simhash", "warc",
]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"latewise.llm.registered.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
