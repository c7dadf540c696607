"""Collects the queries of every family module."""

from __future__ import annotations

import importlib

#: Family modules in this package; each has QUERIES and SQL.
FAMILIES: tuple[str, ...] = ("scalar", "raster", "vector", "maritime", "scenes", "sensor", "lifecycle")


def _families():
    return [importlib.import_module(f"cartosea.plans.{name}") for name in FAMILIES]


def queries():
    """Name -> callable(spark, sf_dir)."""
    return {k: f for m in _families() for k, f in m.QUERIES.items()}


def oracle_sql():
    """Name -> DuckDB SQL."""
    return {k: s for m in _families() for k, s in m.SQL.items()}
