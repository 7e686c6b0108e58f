"""Reports over the finished tables. All inputs but the series are one row per label."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions import polarity
from chronoframe.operators import comparison
from chronoframe.operators.shaping import basis, largest_first, positive, require, starting_with, top_n

GAP = "abs_difference_pp"


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table as one result."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def anchor_report(anchor: DataFrame) -> DataFrame:
    """The comparison, largest gap first, labels without one last."""
    columns = (
        "gics_sector", "comparison_start", "naive_cumulative_return", "pit_cumulative_return",
        "difference_pp", "reclassified_tickers", "misattributed_observations",
    )
    return largest_first(anchor, GAP).select(*columns)


def absent_report(anchor: DataFrame) -> DataFrame:
    """Labels credited with returns from before they existed."""
    return (
        positive(anchor, "pct_period_sector_absent")
        .orderBy(F.desc("pct_period_sector_absent"))
        .select(
            "gics_sector",
            "sector_existed_from",
            "pct_period_sector_absent",
            "naive_full_window_return",
            "naive_cumulative_return",
        )
    )


def kpi_report(anchor: DataFrame) -> DataFrame:
    """The label with the largest gap (the first of equals), and totals over all labels; one aggregate."""
    shown = ("gics_sector", "difference_pp", "comparison_start", "analysis_end")
    ranked = F.struct((-F.col(GAP)).alias("_rank"), *shown)
    worst = anchor.agg(
        F.min(F.when(F.col(GAP).isNotNull(), ranked)).alias("_worst"), *comparison.kpi_totals()
    ).filter(F.col("_worst").isNotNull())
    return worst.select(*[F.col(f"_worst.{c}").alias(c) for c in shown], "role_assignments", "entity_label_moves")


def gap_report(anchor: DataFrame) -> DataFrame:
    """Signed gaps with their direction, smallest magnitude first; no gap, no row."""
    return (
        require(anchor, "difference_pp")
        .orderBy(GAP)
        .select("gics_sector", "difference_pp", GAP, polarity(F.col("difference_pp")).alias("polarity"))
    )


def series_report(cumulative: DataFrame, join_basis: str, focal: str) -> DataFrame:
    """Percentage series of one basis with one label marked."""
    return basis(cumulative, join_basis).select(
        "gics_sector",
        "trade_date",
        (F.col("cumulative_return") * F.lit(100.0)).alias("cumulative_pct"),
        (F.col("gics_sector") == F.lit(focal)).alias("is_focal"),
    )


def pair_report(anchor: DataFrame, n: int = 6) -> DataFrame:
    """Both figures of the n labels with the largest gaps, in that order."""
    return top_n(anchor, GAP, n, tie="gics_sector").select(
        "gics_sector", "naive_cumulative_return", "pit_cumulative_return", GAP
    )


def holdout_report(exclusions: DataFrame) -> DataFrame:
    return starting_with(exclusions, "present_in", "held_out")


def inventory_report(universe: DataFrame, dim: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Sizes shown beside the architecture: entities, versions, exclusions."""
    sizes = table_counts({"ticker_universe": universe, "dim_sector_scd": dim, "excluded_tickers": exclusions})
    later = dim.filter(F.col("version_number") > 1)
    return sizes.unionByName(table_counts({"dim_sector_scd later versions": later}))
