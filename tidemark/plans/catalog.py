"""All registered queries of the library, gathered from the operator modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("scalar_queries", "text_queries", "time_queries", "series_queries", "observed_queries", "range_queries", "product_queries", "source_queries", "grid_queries", "spatial_queries", "projection_queries", "terrain_queries", "feed_queries")


def _modules():
    return [importlib.import_module(f"tidemark.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
