"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["attributes", "search", "analytics", "scalars", "state", "pipelines", "records", "serving", "evidence"]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"sparkloom.queries.{m}").QUERIES
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"sparkloom.queries.{m}").ORACLE
    return out
