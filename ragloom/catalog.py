"""The engine's queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragloom import registry
from ragloom.plans import relational, search, streams, texts  # noqa: F401  (they register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["join3_agg2_reference_audit"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
