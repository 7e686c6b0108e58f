"""The silver and gold layers as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.model import ReportingWindow
from chronoframe.operators import comparison, scd2, universe, windows
from chronoframe.operators.joins import dual_label, scope_to

GOLD_FACT = (
    "ticker", "trade_date", "daily_return", "log_return", "sector_key",
    "sector_at_trade_date", "sector_today", "is_misattributed",
)


@dataclass(frozen=True)
class Bronze:
    """The landed inputs."""

    daily_prices: DataFrame
    current_snapshot: DataFrame
    sector_history: DataFrame
    sector_registry: DataFrame
    excluded_entities: DataFrame


def build_universe(bronze: Bronze) -> DataFrame:
    return universe.build_universe(
        bronze.daily_prices, bronze.current_snapshot, bronze.excluded_entities
    )


def build_exclusions(bronze: Bronze, analysable: DataFrame) -> DataFrame:
    return universe.build_exclusions(
        bronze.daily_prices, bronze.current_snapshot, bronze.excluded_entities, analysable
    )


def build_dimension(analysable: DataFrame, log: DataFrame) -> DataFrame:
    return scd2.with_sector_key(scd2.build_scd2(analysable, log))


def build_returns(prices: DataFrame, analysable: DataFrame, slice_unit: str | None = None) -> DataFrame:
    """Returns of analysable keys; scoping happens before the window."""
    return windows.returns(
        scope_to(prices, analysable), keep=("volume",), slice_unit=slice_unit
    )


def build_fact_pit(
    fact_returns: DataFrame, dim: DataFrame, strategy: str = "range"
) -> DataFrame:
    labelled = dual_label(fact_returns, dim, strategy=strategy)
    keyed = labelled.withColumn("sector_key", F.xxhash64("ticker", "version_number"))
    return keyed.select(*GOLD_FACT)


def build_group_series(fact: DataFrame, window: ReportingWindow) -> tuple[DataFrame, DataFrame]:
    """Daily and cumulative series, both bases."""
    daily = comparison.group_daily(fact, window)
    return daily, windows.cumulative_index(daily)


def build_anchor(
    daily: DataFrame, fact: DataFrame, dim: DataFrame, window: ReportingWindow
) -> DataFrame:
    return comparison.anchor_metric(daily, fact, dim, window)
