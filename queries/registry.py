"""Collects the registered queries of all families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries import comparing, dimension, facts, landing, quality, reporting, universe, warehouse

FAMILIES = (universe, dimension, facts, comparing, quality, reporting, landing, warehouse)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for family in FAMILIES for name, run in family.FAMILY.runs.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.FAMILY.oracles.items()}
