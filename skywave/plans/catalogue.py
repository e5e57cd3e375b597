"""All queries by name, and the SQL that an independent engine can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dashboards, frames, kernels, operations, replays
from .relations import relation, with_views

_PARTS = [dashboards.CATALOGUE, kernels.CATALOGUE, frames.CATALOGUE, operations.CATALOGUE, replays.CATALOGUE]


def _bound(plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(lambda name: relation(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(plan) for part in _PARTS for name, (plan, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for part in _PARTS for name, (_, sql) in part.items() if sql}
