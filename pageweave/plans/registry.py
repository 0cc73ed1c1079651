"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["documents", "corpus", "search", "details"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"pageweave.plans.{m}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
