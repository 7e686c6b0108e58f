"""The full check suite over a built warehouse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.model import CHANGE_REASONS, CHANGE_TYPES, EXCLUSION_CLASSES, JOIN_BASES
from chronoframe.operators import quality as dq
from chronoframe.plans.warehouse import MEMBERSHIP_TABLE

NOT_NULL = {
    "bronze.daily_prices": ("ticker", "trade_date"),
    "bronze.sp500_current_snapshot": ("ticker", "gics_sector"),
    "bronze.sector_history": (
        "ticker", "change_type", "old_gics_sector", "new_gics_sector",
        "effective_after_close", "first_trading_day",
    ),
    "bronze.gics_sector_registry": ("gics_sector", "existed_from"),
    "silver.ticker_universe": ("ticker", "current_gics_sector"),
    "silver.dim_sector_scd": ("sector_key", "ticker", "gics_sector", "valid_from", "is_current"),
    "silver.fact_returns": ("ticker", "trade_date"),
    "gold.fact_returns_pit": (
        "ticker", "trade_date", "sector_at_trade_date", "sector_today", "is_misattributed",
    ),
    "gold.sector_daily_returns": ("join_basis",),
    "gold.anchor_metric": ("gics_sector",),
}

UNIQUE = {
    "bronze.sp500_current_snapshot": (("ticker",),),
    "bronze.gics_sector_registry": (("gics_sector",),),
    "bronze.daily_prices": (("ticker", "trade_date"),),
    "bronze.sector_history": (("ticker", "first_trading_day"),),
    "bronze.sp500_membership": (("ticker", "start_date"),),
    "bronze.excluded_entities": (("ticker",),),
    "silver.ticker_universe": (("ticker",),),
    "silver.excluded_tickers": (("ticker", "present_in"),),
    "silver.stg_sector_events": (("ticker", "first_trading_day"),),
    "silver.dim_sector_scd": (("sector_key",), ("ticker", "version_number")),
    "silver.fact_returns": (("ticker", "trade_date"),),
    "gold.fact_returns_pit": (("ticker", "trade_date"),),
    "gold.sector_daily_returns": (("join_basis", "gics_sector", "trade_date"),),
    "gold.sector_cumulative_returns": (("join_basis", "gics_sector", "trade_date"),),
    "gold.anchor_metric": (("gics_sector",),),
}

ACCEPTED = (
    ("bronze.excluded_entities", "exclusion_class", EXCLUSION_CLASSES),
    ("silver.stg_sector_events", "change_type", CHANGE_TYPES),
    ("silver.dim_sector_scd", "change_reason", CHANGE_REASONS),
    ("gold.sector_daily_returns", "join_basis", JOIN_BASES),
    ("gold.sector_cumulative_returns", "join_basis", JOIN_BASES),
)


def warehouse_checks(spark: SparkSession) -> dict[str, DataFrame]:
    """Every check as a lazy frame of violating rows, to look into what ``run`` has counted."""
    table = spark.table
    dim, facts = table("silver.dim_sector_scd"), table("silver.fact_returns")
    log, analysable = table("bronze.sector_history"), table("silver.ticker_universe")
    checks = {
        "versions do not overlap": dq.overlaps(dim),
        "exactly one current version": dq.current_row_violations(dim),
        "no observed day in a gap": dq.gap_days(dim, facts),
        "every fact resolves to one version": dq.integrity_violations(facts, dim),
        "every change was applied": dq.unapplied_changes(log, analysable, dim),
        "reconciliation is empty": table("silver.dim_reconciliation"),
        "no label outside its lifetime": table("silver.sector_existence_violations"),
        "version rows are well formed": dq.scd2_shape(dim),
        "change dates are ordered": dq.ordered(
            log, "effective_after_close", "first_trading_day", strict=True
        ),
    }
    for name, columns in NOT_NULL.items():
        checks[f"not null: {name}"] = dq.not_null(table(name), columns)
    for name, keys in UNIQUE.items():
        if name == MEMBERSHIP_TABLE and not spark.catalog.tableExists(name):
            continue  # memberships need not be loaded
        for key in keys:
            checks[f"unique: {name} ({', '.join(key)})"] = dq.unique(table(name), key)
    for name, column, values in ACCEPTED:
        checks[f"accepted: {name} ({column})"] = dq.accepted(table(name), column, values)
    return checks


def warehouse_rules() -> dict[str, dict[str, dq.Rule]]:
    """The rules of each table that need no other table."""
    rules: dict[str, dict[str, dq.Rule]] = {}
    for name, columns in NOT_NULL.items():
        rules.setdefault(name, {})[f"not null: {name}"] = dq.NotNull(columns)
    for name, keys in UNIQUE.items():
        for key in keys:
            rules.setdefault(name, {})[f"unique: {name} ({', '.join(key)})"] = dq.Unique(key)
    for name, column, values in ACCEPTED:
        rules.setdefault(name, {})[f"accepted: {name} ({column})"] = dq.Accepted(column, tuple(values))
    not_after = F.col("first_trading_day") <= F.col("effective_after_close")
    rules["bronze.sector_history"]["change dates are ordered"] = dq.Rows((not_after,))
    return rules


def run(spark: SparkSession) -> DataFrame:
    """Every check: violations and verdict. A table's own rules take one pass over it, the history another."""
    table = spark.table
    counted = [dq.history_checks(table("silver.dim_sector_scd"), table("silver.fact_returns"))]
    for name, rules in warehouse_rules().items():
        if name == MEMBERSHIP_TABLE and not spark.catalog.tableExists(name):
            continue  # memberships need not be loaded
        counted.append(dq.table_checks(table(name), rules))
    between = {
        "every change was applied": dq.unapplied_changes(table("bronze.sector_history"), table("silver.ticker_universe"), table("silver.dim_sector_scd")),
        "reconciliation is empty": table("silver.dim_reconciliation"),
        "no label outside its lifetime": table("silver.sector_existence_violations"),
    }
    counted.append(dq.run_suite(between).drop("status"))
    return dq.verdicts(reduce(DataFrame.unionByName, counted))
