"""Data-quality checks. Each returns the violating rows; no row means healthy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import day_of, effective_end
from chronoframe.model import CHANGE_REASONS, IntegrityError
from chronoframe.operators.joins import match_counts


def overlaps(dim: DataFrame, key: str = "ticker") -> DataFrame:
    """Versions that start before an earlier version of their key has ended.

    Each is shown beside the earlier version reaching furthest. A running
    maximum per key finds every offender in one pass; the number of pairs,
    which can be quadratic, never matters.
    """
    earlier = (
        Window.partitionBy(key)
        .orderBy("valid_from", "version_number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.struct(
        effective_end(F.col("valid_to")).alias("until"),
        F.col("valid_from").alias("from"),
        F.col("valid_to").alias("to"),
    )
    marked = dim.withColumn("_furthest", F.max(reach).over(earlier))
    return marked.filter(F.col("_furthest.until") >= F.col("valid_from")).select(
        key,
        F.col("_furthest.from").alias("version_a_from"),
        F.col("_furthest.to").alias("version_a_to"),
        F.col("valid_from").alias("version_b_from"),
        F.col("valid_to").alias("version_b_to"),
    )


def current_row_violations(dim: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys without exactly one current row, keys with none included."""
    counted = dim.groupBy(key).agg(F.count_if(F.col("is_current")).alias("current_row_count"))
    return counted.filter(F.col("current_row_count") != 1)


def gap_days(
    dim: DataFrame, facts: DataFrame, *, key: str = "ticker", time: str = "trade_date"
) -> DataFrame:
    """Observed days strictly between one version's end and the next one's start.

    Boundaries without a calendar day in between are dropped before the join,
    so usually almost nothing is joined.
    """
    history = Window.partitionBy(key).orderBy("valid_from")
    boundaries = dim.select(
        key,
        F.col("valid_to").alias("gap_starts_after"),
        F.lead("valid_from").over(history).alias("gap_ends_before"),
    ).filter(F.col("gap_ends_before") > F.date_add("gap_starts_after", 1))
    inside = (F.col("_key") == F.col(key)) & (day_of(time) > F.col("gap_starts_after")) & (
        day_of(time) < F.col("gap_ends_before")
    )
    observed = facts.select(F.col(key).alias("_key"), time)
    return observed.join(boundaries, inside).select(
        key, "gap_starts_after", "gap_ends_before", F.col(time).alias("orphaned_trading_day")
    )


def integrity_violations(
    facts: DataFrame, dim: DataFrame, *, key: str = "ticker", time: str = "trade_date"
) -> DataFrame:
    """Facts that do not resolve to exactly one version, with the number found."""
    return match_counts(facts, dim, key=key, time=time).filter(
        F.col("matching_dimension_rows") != 1
    )


def unapplied_changes(
    log: DataFrame, universe: DataFrame, dim: DataFrame, key: str = "ticker"
) -> DataFrame:
    """Keys named in the change log that have fewer than two versions.

    Both sides are reduced to one row per key before they meet, so several
    events of a key do not multiply its versions.
    """
    changed = log.select(key).distinct().join(universe.select(key), key, "left_semi")
    versions = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_versions"))
    counted = changed.join(versions, key, "left").select(
        key, F.coalesce(F.col("_versions"), F.lit(0).cast("bigint")).alias("dimension_rows")
    )
    return counted.filter(F.col("dimension_rows") < 2)


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns holding NULLs, with the number of NULLs; one pass for all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.select(
        F.expr(f"stack({len(columns)}, {pairs}) as (column_name, null_rows)")
    ).filter(F.col("null_rows") > 0)


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.filter(F.col("occurrences") > 1)


def accepted(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the allowed set, with how often they occur."""
    strange = df.filter(~F.col(column).isin(list(values)))
    return strange.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences"))


def ordered(df: DataFrame, low: str, high: str, *, strict: bool) -> DataFrame:
    """Rows whose two dates are in the wrong order."""
    wrong = F.col(high) <= F.col(low) if strict else F.col(high) < F.col(low)
    return df.filter(wrong)


def shape_rules() -> dict[str, Column]:
    """What breaks a version row, by name."""
    return {
        "version below one": F.col("version_number") < 1,
        "current flag and end disagree": F.col("is_current") != F.col("valid_to").isNull(),
        "ends before it starts": F.col("valid_to") < F.col("valid_from"),
        "unknown change reason": ~F.col("change_reason").isin(list(CHANGE_REASONS)),
    }


def scd2_shape(dim: DataFrame) -> DataFrame:
    """Version rows breaking a row-level rule, with the rule they break."""
    rules = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in shape_rules().items()]), lambda rule: rule.isNotNull())
    return dim.select("ticker", "version_number", "valid_from", "valid_to", F.explode(rules).alias("broken_rule"))


def group_size_violations(df: DataFrame, keys: Sequence[str], *, least: int, most: int) -> DataFrame:
    """Groups with fewer or more rows than allowed."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    return counted.filter(~F.col("group_rows").between(least, most))


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """One row with the actual count where the table does not hold n rows."""
    return df.agg(F.count(F.lit(1)).alias("actual_rows")).filter(F.col("actual_rows") != n)


def assert_empty(violations: DataFrame, name: str) -> None:
    """Raise when a check has violating rows; looks at one row only."""
    if not violations.isEmpty():
        raise IntegrityError(f"{name} has violating rows")


def run_suite(checks: Mapping[str, DataFrame]) -> DataFrame:
    """All checks as one table: name, number of violations, verdict."""
    counted = [
        violations.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"
        )
        for name, violations in checks.items()
    ]
    return verdicts(reduce(DataFrame.unionByName, counted))


def warnings(checks: Mapping[str, DataFrame]) -> DataFrame:
    """Only the checks that found something."""
    return run_suite(checks).filter("status = 'fail'").drop("status")


# --- all checks of a table in one pass ---------------------------------------------------


@dataclass(frozen=True)
class NotNull:
    """Counts the columns that hold a NULL."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    """Counts the key values that occur more than once."""

    key: tuple[str, ...]


@dataclass(frozen=True)
class Accepted:
    """Counts the different values outside of the allowed ones; NULL is allowed."""

    column: str
    values: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Rows:
    """Counts the rows that meet any of the conditions, once for each."""

    broken: tuple[Column, ...]


Rule = NotNull | Unique | Accepted | Rows


def table_checks(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """(check_name, violations) of all rules of one table, which is read once.

    Every key and every checked value is a grouping set of one aggregation, the whole table
    another; conditions are counted along. Only keys that must be unique cost a shuffle of
    their size, the rest is reduced where it is read.
    """
    grouped: list[tuple[str, ...]] = []
    conditions: list[Column] = []

    def group(columns: tuple[str, ...]) -> int:
        if columns not in grouped:
            grouped.append(columns)
        return grouped.index(columns)

    places: dict[str, tuple[int, list[int]]] = {}
    for name, rule in rules.items():
        match rule:
            case Unique(key):
                places[name] = (group(key), [])
            case Accepted(column, _):
                places[name] = (group((column,)), [])
            case NotNull(columns):
                broken = [F.col(f"`{c}`").isNull() for c in columns]
                places[name] = (group(()), list(range(len(conditions), len(conditions) + len(broken))))
                conditions += broken
            case Rows(broken):
                places[name] = (group(()), list(range(len(conditions), len(conditions) + len(broken))))
                conditions += broken
    columns = sorted({c for key in grouped for c in key})
    flags = [c.alias(f"_flag{k}") for k, c in enumerate(conditions)]
    narrow = df.select(*[F.col(f"`{c}`").alias(f"_key{k}") for k, c in enumerate(columns)], *flags)
    counts = [F.count(F.lit(1)).alias("_n"), *[F.count_if(f"_flag{k}").alias(f"_c{k}") for k in range(len(flags))]]
    number = {c: f"_key{k}" for k, c in enumerate(columns)}
    if columns:
        sets = [[F.col(number[c]) for c in key] for key in grouped]
        found = narrow.groupingSets(sets, *number.values()).agg(F.grouping_id().alias("_set"), *counts)
    else:
        found = narrow.agg(*counts).withColumn("_set", F.lit(0).cast("bigint"))
    # A set's number has a bit for each column that it leaves out, the first column highest.
    bits = [sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in key) for key in grouped]

    def violations(name: str, rule: Rule) -> Column:
        at, flagged = places[name]
        here = F.col("_set") == bits[at]
        match rule:
            case Unique():
                return F.count_if(here & (F.col("_n") > 1))
            case Accepted(column, values):
                return F.count_if(here & ~F.col(number[column]).isin(list(values)))
            case NotNull():
                return sum((F.count_if(here & (F.col(f"_c{k}") > 0)) for k in flagged), F.lit(0).cast("bigint"))
            case Rows():
                return F.coalesce(F.max(F.when(here, sum((F.col(f"_c{k}") for k in flagged), F.lit(0).cast("bigint")))), F.lit(0).cast("bigint"))

    return _as_rows(found.agg(*[violations(name, rule).alias(f"_v{k}") for k, (name, rule) in enumerate(rules.items())]), list(rules))


def _as_rows(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of counts ``_v0``, ``_v1``, ... as rows of name and count."""
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"_v{k}").alias("violations")) for k, n in enumerate(names)])
    return counted.select(F.explode(pairs).alias("_check")).select("_check.*")


# Fixed order of what ``history_checks`` reports.
HISTORY_CHECKS = ("versions do not overlap", "exactly one current version", "no observed day in a gap", "every fact resolves to one version", "version rows are well formed")


def history_checks(dim: DataFrame, facts: DataFrame, *, key: str = "ticker", time: str = "trade_date") -> DataFrame:
    """(check_name, violations) of the checks on versions and on the facts that they label.

    Versions and facts are read once each, brought together by key once and walked in order of
    days; the counts are those of ``overlaps``, ``current_row_violations``, ``gap_days``,
    ``integrity_violations`` and ``scd2_shape``. Facts of one key and day go on as one row. A day
    is in a gap if the last version begun by then has ended and another one follows; of versions
    that begin on one day, the one with the highest number is the last.
    """
    none = lambda kind: F.lit(None).cast(kind)
    until = effective_end(F.col("valid_to"))
    upright = F.col("valid_from") <= until
    broken = sum((F.coalesce(rule, F.lit(False)).cast("int") for rule in shape_rules().values()), F.lit(0))

    def mark(day: Column, kind: int, opened: Column, seen: Column, **version: Column) -> Column:
        return F.struct(
            day.alias("_day"), F.lit(kind).alias("_kind"), opened.cast("bigint").alias("_opened"), seen.cast("bigint").alias("_seen"),
            version.get("number", none("int")).alias("_number"), version.get("until", none("date")).alias("_until"),
            version.get("current", none("boolean")).alias("_current"), version.get("broken", none("int")).alias("_broken"),
        )

    zero = F.lit(0)
    begin = mark(F.col("valid_from"), 0, upright.cast("int"), zero, number=F.col("version_number").cast("int"), until=until, current=F.col("is_current"), broken=broken)
    end = F.when(upright & F.col("valid_to").isNotNull(), mark(F.col("valid_to"), 2, F.lit(-1), zero))
    versions = dim.select(F.col(key).alias("_key"), F.explode(F.array_compact(F.array(begin, end))).alias("_mark")).select("_key", "_mark.*")
    seen = facts.groupBy(F.col(key).alias("_key"), day_of(time).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    observed = seen.select("_key", mark(F.col("_day"), 1, zero, F.col("_n")).alias("_mark")).select("_key", "_mark.*")

    whole = Window.partitionBy("_key")
    in_order = whole.orderBy("_day", "_kind", "_number")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.col("_kind") == 0
    walked = versions.unionByName(observed).select(
        "*",
        F.max("_until").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"),
        F.last("_until", ignorenulls=True).over(so_far).alias("_latest"),
        F.sum("_opened").over(so_far).alias("_open"),
        F.count_if(begun).over(so_far).alias("_begun"),
        F.row_number().over(in_order).alias("_place"),
        F.count_if(begun).over(whole).alias("_versions"),
        F.count_if(F.col("_current")).over(whole).alias("_currents"),
    )
    fact = F.col("_kind") == 1
    in_gap = fact & (F.col("_latest") < F.col("_day")) & (F.col("_begun") < F.col("_versions"))
    counts = (
        F.count_if(begun & (F.col("_reach") >= F.col("_day"))),
        F.count_if((F.col("_place") == 1) & (F.col("_versions") > 0) & (F.col("_currents") != 1)),
        F.coalesce(F.sum(F.when(in_gap, F.col("_seen"))), zero.cast("bigint")),
        F.count_if(fact & (F.col("_open") * F.col("_seen") != 1)),
        F.coalesce(F.sum("_broken"), zero).cast("bigint"),
    )
    return _as_rows(walked.agg(*[c.alias(f"_v{k}") for k, c in enumerate(counts)]), HISTORY_CHECKS)


def verdicts(counted: DataFrame) -> DataFrame:
    """Counts of violations with the verdict beside them."""
    return counted.withColumn("status", F.when(F.col("violations") == 0, F.lit("pass")).otherwise(F.lit("fail")))
