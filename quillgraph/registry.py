"""All registered queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import catalog, extended
from quillgraph.plans.sql import SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.QUERIES | extended.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | extended.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extended.routed_topk(spark, sf_dir)
