"""All queries of the engine and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import building, checks, core, eligibility, knowledge, reading, records, scalars, serving
from .queries.registry import ORACLES, QUERIES

__all__ = ["building", "checks", "core", "eligibility", "knowledge", "reading", "records", "scalars", "serving"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
