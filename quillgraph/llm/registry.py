"""Queries pN_... over the project's tables, and SQL where SQL can state them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("names", "grouping", "crosssplit", "splitting", "lookalikes", "pairs", "packing", "leakage", "encoding")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"quillgraph.llm.{name}"), attribute)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
