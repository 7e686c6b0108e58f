"""Ordered build of the layers into catalog tables.

Tables are the cut points: each result with several readers is written once and
read back, so a lost executor never costs more than its own stage and nothing is
recomputed. The large fact tables are bucketed and sorted by the key, which
lets the window and the range join run without a shuffle.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chronoframe.model import IntegrityError, ReportingWindow
from chronoframe.operators import scd2, universe
from chronoframe.operators.quality import assert_empty, current_row_violations, unique, warnings
from chronoframe.plans import layers
from chronoframe.sinks import analyze, create_namespaces, drop_table, noted, store_table
from chronoframe.sinks.tables import BUILT_FROM, CONTENT

LAYERS = ("silver", "gold")
BRONZE_TABLES = {
    "daily_prices": "bronze.daily_prices",
    "current_snapshot": "bronze.sp500_current_snapshot",
    "sector_history": "bronze.sector_history",
    "sector_registry": "bronze.gics_sector_registry",
    "excluded_entities": "bronze.excluded_entities",
}
MEMBERSHIP_TABLE = "bronze.sp500_membership"
# A task sorts one bucket: so many rows of prices or returns take some hundred megabytes.
BUCKET_ROWS = 1_000_000


@dataclass
class BuildReport:
    """Seconds per table stored, tables left as they are, and the diagnostics that found something."""

    seconds: dict[str, float] = field(default_factory=dict)
    unchanged: list[str] = field(default_factory=list)
    warnings: DataFrame | None = None

    @property
    def total_seconds(self) -> float:
        return sum(self.seconds.values())


def buckets_for(rows: int, least: int = 4) -> int:
    """The bucket count for a number of prices, so that a bucket stays of one size however many there are."""
    return max(least, -(-rows // BUCKET_ROWS))


def load_bronze(
    spark: SparkSession, frames: dict[str, DataFrame], *, tables: Sequence[str] | None = None, recreate: bool = False,
    buckets: int | None = None,
) -> None:
    """Land source frames as bronze tables.

    ``tables`` restricts the load to some of them (leaving, say, the large price
    table untouched); ``recreate`` drops every bronze table first.
    """
    create_namespaces(spark)
    names = {**BRONZE_TABLES, "membership": MEMBERSHIP_TABLE}
    if recreate:
        for name in names.values():
            drop_table(spark, name)
    for role, df in frames.items():
        if tables is not None and role not in tables:
            continue
        keyed = role == "daily_prices" and buckets
        store_table(
            df, names[role], bucket_by=("ticker",) if keyed else (), sort_by=("ticker", "trade_date") if keyed else (),
            buckets=buckets or 0,
        )
        analyze(spark, names[role])


def read_bronze(spark: SparkSession) -> layers.Bronze:
    return layers.Bronze(**{role: spark.table(name) for role, name in BRONZE_TABLES.items()})


@dataclass(frozen=True)
class Step:
    """A table, what it is built from, and what must hold once it is stored.

    ``build`` and ``holds`` take the tables read, in the order of ``reads``, and the window;
    ``holds`` gets the table itself first and gives names and violating rows.
    """

    name: str
    reads: tuple[str, ...]
    build: Callable[..., DataFrame]
    by_key: tuple[str, ...] = ()
    cluster_by: tuple[str, str] | None = None
    windowed: bool = False
    holds: Callable[..., Mapping[str, DataFrame]] | None = None


_PRICES, _SNAPSHOT, _LOG, _REGISTRY, _HELD = BRONZE_TABLES.values()
_UNIVERSE, _EVENTS, _DIM, _RETURNS = "silver.ticker_universe", "silver.stg_sector_events", "silver.dim_sector_scd", "silver.fact_returns"
_FACT, _DAILY = "gold.fact_returns_pit", "gold.sector_daily_returns"

STEPS = (
    Step(_UNIVERSE, (_PRICES, _SNAPSHOT, _HELD), lambda prices, snapshot, held, window: universe.build_universe(prices, snapshot, held)),
    Step(
        "silver.excluded_tickers", (_PRICES, _SNAPSHOT, _HELD, _UNIVERSE),
        lambda prices, snapshot, held, analysable, window: universe.build_exclusions(prices, snapshot, held, analysable),
    ),
    Step(
        _EVENTS, (_LOG, _UNIVERSE), lambda log, analysable, window: scd2.stage_events(log, analysable),
        holds=lambda events, log, analysable: {
            "repeated change events": unique(events, ["ticker", "first_trading_day"]),
            "closed and opened versions": scd2.replay_imbalance(analysable, events),
        },
    ),
    Step(
        _DIM, (_UNIVERSE, _EVENTS), lambda analysable, events, window: layers.build_dimension(analysable, events), by_key=("ticker", "valid_from"),
        holds=lambda dim, analysable, events: {"current versions": current_row_violations(dim)},
    ),
    Step("silver.dim_reconciliation", (_DIM, _UNIVERSE), lambda dim, analysable, window: scd2.reconcile(dim, analysable)),
    Step(
        "silver.sector_existence_violations", (_DIM, _REGISTRY),
        lambda dim, registry, window: scd2.existence_violations(dim, registry, window), windowed=True,
    ),
    Step(
        _RETURNS, (_PRICES, _UNIVERSE), lambda prices, analysable, window: layers.build_returns(prices, analysable), by_key=("ticker", "trade_date"),
        holds=lambda returns, prices, analysable: {"repeated prices": unique(prices, ["ticker", "trade_date"])},
    ),
    Step(
        _FACT, (_RETURNS, _DIM), lambda returns, dim, window: layers.build_fact_pit(returns, dim),
        cluster_by=("sector_at_trade_date", "trade_date"),
    ),
    Step(_DAILY, (_FACT,), lambda fact, window: layers.build_group_series(fact, window)[0], windowed=True),
    Step("gold.sector_cumulative_returns", (_DAILY,), lambda daily, window: layers.windows.cumulative_index(daily)),
    Step("gold.anchor_metric", (_DAILY, _FACT, _DIM), layers.build_anchor, windowed=True),
)
BUILT_TABLES = tuple(step.name for step in STEPS)


def build_all(
    spark: SparkSession, window: ReportingWindow, *, buckets: int, only: Sequence[str] = LAYERS,
    strict: bool = False, resume: bool = False,
) -> BuildReport:
    """Build silver, gold or both, in dependency order.

    ``buckets`` is the bucket count of the fact tables; choose it so that one
    bucket is a few hundred megabytes, as ``buckets_for`` does. Repeated (key, day) events or prices, a
    replay that closes and opens unlike numbers of versions, and keys without
    exactly one current version stop the build before gold is touched;
    ``strict`` does the same for non-empty diagnostics.

    With ``resume``, a table stays as it is if it was built from the same rows before, by the
    fingerprints noted with the tables, for the same window and buckets. So a build that stopped goes on
    where it was, and a change costs its descendants only, as far as their own rows change.
    A check that failed leaves no note, so its table is built again.
    """
    unknown = set(only) - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    create_namespaces(spark)
    report = BuildReport()
    contents: dict[str, str | None] = {}

    def content(name: str) -> str | None:
        if name not in contents:
            contents[name] = noted(spark, name, CONTENT)
        return contents[name]

    def judge() -> None:
        report.warnings = warnings(diagnostics(spark))
        if strict and not report.warnings.isEmpty():
            raise IntegrityError("silver diagnostics are not empty")

    for step in STEPS:
        layer = step.name.partition(".")[0]
        if layer not in only:
            continue
        if layer == "gold" and "silver" in only and report.warnings is None:
            judge()
        known = [content(name) for name in step.reads]
        told = [step.name, *map(str, known), str(window) if step.windowed else "", str(buckets) if step.by_key else ""]
        built_from = hashlib.sha256("\n".join(told).encode()).hexdigest()
        if resume and None not in known and noted(spark, step.name, BUILT_FROM) == built_from:
            report.unchanged.append(step.name)
            continue
        started = time.perf_counter()
        read = [spark.table(name) for name in step.reads]
        how = {"bucket_by": step.by_key[:1], "sort_by": step.by_key, "buckets": buckets} if step.by_key else {"cluster_by": step.cluster_by}
        contents[step.name] = store_table(step.build(*read, window), step.name, **how)
        if step.holds:
            for name, violations in step.holds(spark.table(step.name), *read).items():
                assert_empty(violations, name)
        spark.sql(f"ALTER TABLE {step.name} SET TBLPROPERTIES ('{BUILT_FROM}' = '{built_from}')")
        analyze(spark, step.name)
        report.seconds[step.name] = time.perf_counter() - started
    if "silver" in only and report.warnings is None:
        judge()
    return report


def diagnostics(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        name: spark.table(name)
        for name in ("silver.dim_reconciliation", "silver.sector_existence_violations")
    }

