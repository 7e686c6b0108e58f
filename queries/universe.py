"""Coverage, analysable universe, exclusion ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronoframe.operators import joins, shaping
from chronoframe.operators import universe as ops
from chronoframe.plans.reports import inventory_report
from chronoframe.sources import corpus_profile
from queries.family import Family
from queries.mapping import Inputs

FAMILY = Family()
HASHED = {"find": "#", "put": "-"}


def _universe(i: Inputs) -> DataFrame:
    return ops.build_universe(i.named_prices(), i.named_snapshot(), i.holdouts(), **HASHED)


@FAMILY.query(
    "SELECT ticker, min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, count(*) AS trading_days FROM prices GROUP BY ticker",
    "prices",
)
def coverage_per_key(i: Inputs) -> DataFrame:
    return ops.coverage(i.prices())


@FAMILY.query(
    "SELECT count(*) AS row_count, count(DISTINCT ticker) AS distinct_keys, min(trade_date) AS first_date, max(trade_date) AS last_date FROM prices",
    "prices",
)
def corpus_summary(i: Inputs) -> DataFrame:
    return corpus_profile(i.prices())


@FAMILY.query("SELECT * FROM named_universe", "named_universe")
def universe(i: Inputs) -> DataFrame:
    return _universe(i)


_LEDGER = """
SELECT s.ticker, 'snapshot_only' AS present_in, '{snapshot}' AS exclusion_reason
FROM named_snapshot s WHERE s.ticker NOT IN (SELECT snapshot_ticker FROM named_universe) {held}
UNION ALL
SELECT DISTINCT p.ticker, 'prices_only', '{prices}'
FROM named_prices p
WHERE p.ticker NOT IN (SELECT ticker FROM named_universe) AND p.ticker NOT IN (SELECT ticker FROM holdouts)
UNION ALL
SELECT ticker, 'held_out:' || exclusion_class, exclusion_reason FROM holdouts"""
_TEXTS = {"snapshot": ops.SNAPSHOT_ONLY_REASON, "prices": ops.PRICES_ONLY_REASON}
_SOURCES = ("named_universe", "named_snapshot", "named_prices", "holdouts")


@FAMILY.query(
    _LEDGER.format(held="AND replace(s.ticker, '#', '-') NOT IN (SELECT ticker FROM holdouts)", **_TEXTS), *_SOURCES
)
def exclusions(i: Inputs) -> DataFrame:
    return ops.build_exclusions(i.named_prices(), i.named_snapshot(), i.holdouts(), _universe(i), **HASHED)


@FAMILY.query(_LEDGER.format(held="", **_TEXTS), *_SOURCES)
def exclusions_holdouts_twice(i: Inputs) -> DataFrame:
    return ops.build_exclusions(
        i.named_prices(), i.named_snapshot(), i.holdouts(), _universe(i), list_holdouts_once=False, **HASHED
    )


@FAMILY.query(
    """
SELECT DISTINCT p.ticker, 'prices' AS present_in FROM named_prices p
WHERE p.ticker NOT IN (SELECT replace(ticker, '#', '-') FROM named_snapshot)
UNION ALL
SELECT replace(ticker, '#', '-'), 'snapshot' FROM named_snapshot
WHERE replace(ticker, '#', '-') NOT IN (SELECT ticker FROM named_prices)""",
    "named_prices",
    "named_snapshot",
)
def key_mismatches(i: Inputs) -> DataFrame:
    return joins.mismatches(
        i.named_prices(), ops.normalised_snapshot(i.named_snapshot(), **HASHED), tags=("prices", "snapshot")
    )


@FAMILY.query("SELECT ticker, present_in, exclusion_reason FROM (" + _LEDGER.format(held="", **_TEXTS) + ") WHERE present_in LIKE 'held_out%'", *_SOURCES)
def report_holdouts(i: Inputs) -> DataFrame:
    ledger = ops.build_exclusions(
        i.named_prices(), i.named_snapshot(), i.holdouts(), _universe(i), list_holdouts_once=False, **HASHED
    )
    return shaping.starting_with(ledger, "present_in", "held_out")


@FAMILY.query(
    """
SELECT 'ticker_universe' AS table_name, count(*) AS row_count FROM named_universe
UNION ALL SELECT 'dim_sector_scd', count(*) FROM dim
UNION ALL SELECT 'excluded_tickers', (SELECT count(*) FROM (""" + _LEDGER.format(held="AND replace(s.ticker, '#', '-') NOT IN (SELECT ticker FROM holdouts)", **_TEXTS) + """))
UNION ALL SELECT 'dim_sector_scd later versions', count(*) FROM dim WHERE version_number > 1""",
    *_SOURCES,
    "dim",
)
def report_inventory(i: Inputs) -> DataFrame:
    analysable = _universe(i)
    ledger = ops.build_exclusions(i.named_prices(), i.named_snapshot(), i.holdouts(), analysable, **HASHED)
    return inventory_report(analysable, i.dim(), ledger)
