"""Which entities can be analysed, and why the others cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions import normalise_key, tagged
from chronoframe.operators.joins import exclude
from chronoframe.operators.shaping import union_all

SNAPSHOT_ONLY_REASON = "listed today, but without a single observation"
PRICES_ONLY_REASON = "has observations, but no current label"


def coverage(prices: DataFrame, key: str = "ticker", time: str = "trade_date") -> DataFrame:
    """Extent of each key's series: one partial-plus-final hash aggregate."""
    return prices.groupBy(key).agg(
        F.min(time).alias("first_trade_date"),
        F.max(time).alias("last_trade_date"),
        F.count(F.lit(1)).alias("trading_days"),
    )


def normalised_snapshot(snapshot: DataFrame, find: str = ".", put: str = "-") -> DataFrame:
    return snapshot.select(
        normalise_key(F.col("ticker"), find, put).alias("ticker"),
        F.col("ticker").alias("snapshot_ticker"),
        "security_name",
        F.col("gics_sector").alias("current_gics_sector"),
        F.col("gics_sub_industry").alias("current_sub_industry"),
    )


def build_universe(
    prices: DataFrame, snapshot: DataFrame, holdouts: DataFrame, *, find: str = ".", put: str = "-"
) -> DataFrame:
    """Keys with observations and a current label, minus the hold-outs.

    Observations are aggregated before the join, so the join sees one row per key.
    """
    labelled = normalised_snapshot(snapshot, find, put).filter(F.col("current_gics_sector").isNotNull())
    analysable = coverage(prices).join(labelled, "ticker")
    return exclude(analysable, holdouts).select(
        "ticker",
        "snapshot_ticker",
        "security_name",
        "current_gics_sector",
        "current_sub_industry",
        "first_trade_date",
        "last_trade_date",
        "trading_days",
    )


def build_exclusions(
    prices: DataFrame,
    snapshot: DataFrame,
    holdouts: DataFrame,
    universe: DataFrame,
    *,
    find: str = ".",
    put: str = "-",
    list_holdouts_once: bool = True,
) -> DataFrame:
    """Ledger of everything the universe left out, in both directions.

    A held-out key that the snapshot lists is recorded as held out only. With
    ``list_holdouts_once=False`` it is also recorded as ``snapshot_only``.
    """
    listed = normalised_snapshot(snapshot, find, put).select("ticker", "snapshot_ticker")
    unmatched = listed.join(universe.select("snapshot_ticker"), "snapshot_ticker", "left_anti")
    if list_holdouts_once:
        unmatched = exclude(unmatched, holdouts)
    observed_only = exclude(exclude(prices.select("ticker").distinct(), universe), holdouts)

    def ledger(df: DataFrame, key: str, tag: str, reason: str) -> DataFrame:
        return df.select(
            F.col(key).alias("ticker"),
            F.lit(tag).alias("present_in"),
            F.lit(reason).alias("exclusion_reason"),
        )

    held = holdouts.select(
        "ticker",
        tagged("held_out:", F.col("exclusion_class")).alias("present_in"),
        "exclusion_reason",
    )
    return union_all(
        ledger(unmatched, "snapshot_ticker", "snapshot_only", SNAPSHOT_ONLY_REASON),
        ledger(observed_only, "ticker", "prices_only", PRICES_ONLY_REASON),
        held,
    )
