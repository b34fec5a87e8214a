"""Registered queries with their SQL checks."""

from __future__ import annotations

import importlib

from evalspark.catalog.registry import QUERIES, SQL, Query

MODULES = ["scoring", "resampling", "vectors", "ranks", "files"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"evalspark.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
