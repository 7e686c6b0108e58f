"""Ordered per-key computations: previous value, returns, running index.

A window task holds every row of its partition key. With one row per key and
calendar day that is bounded by the calendar, however large the table is. For
finer-grained times pass ``slice_unit``: the window is then cut into calendar
slices, which spreads a hot key over many tasks, and the value crossing a slice
border comes from a pre-aggregated table with one row per key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import guarded_growth, log_return, simple_return
from chronoframe.operators.shaping import require


def previous(
    df: DataFrame,
    value: str,
    *,
    key: str = "ticker",
    time: str = "trade_date",
    into: str = "previous",
    tie: str | None = None,
    slice_unit: str | None = None,
) -> DataFrame:
    """Value of the previous *observed* row of the same key.

    ``tie`` orders rows of one key and time. Rows without a key follow each other
    like those of any key.
    """
    order = [time] if tie is None else [time, tie]
    if slice_unit is None:
        ordered = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(into, F.lag(value).over(ordered))

    sliced = df.withColumn("_slice", F.date_trunc(slice_unit, F.col(time)))
    last_of_slice = sliced.groupBy(key, "_slice").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    carried = last_of_slice.select(
        F.col(key).alias("_carried_key"),
        F.col("_slice").alias("_carried_slice"),
        F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_carried"),
    )
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    return (
        sliced.withColumns(
            {"_inner": F.lag(value).over(inside), "_position": F.row_number().over(inside)}
        )
        .join(
            carried,
            F.col(key).eqNullSafe(F.col("_carried_key")) & F.col("_slice").eqNullSafe(F.col("_carried_slice")),
            "left",
        )
        .withColumn(into, F.when(F.col("_position") == 1, F.col("_carried")).otherwise(F.col("_inner")))
        .drop("_slice", "_inner", "_position", "_carried", "_carried_key", "_carried_slice")
    )


def returns(
    df: DataFrame,
    *,
    key: str = "ticker",
    time: str = "trade_date",
    value: str = "close_price",
    keep: Sequence[str] = (),
    slice_unit: str | None = None,
) -> DataFrame:
    """Simple and log returns against the previous observed row.

    Rows without a value are removed first, so a gap in the series does not
    break the chain.
    """
    observed = require(df.select(key, time, value, *keep), value)
    chained = previous(observed, value, key=key, time=time, into="prev_close", slice_unit=slice_unit)
    return chained.select(
        key,
        time,
        value,
        "prev_close",
        simple_return(F.col(value), F.col("prev_close")).alias("daily_return"),
        log_return(F.col(value), F.col("prev_close")).alias("log_return"),
        *keep,
    )


def cumulative_index(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("join_basis", "gics_sector"),
    time: str = "trade_date",
    measure: str = "mean_return",
) -> DataFrame:
    """Compound a series of period returns into a running index.

    Input grain is one row per group and day, so a window is bounded by the
    calendar. The running sum is evaluated once; the return derives from it.
    """
    running = (
        Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    indexed = df.select(
        *keys,
        time,
        measure,
        F.exp(F.sum(guarded_growth(F.col(measure))).over(running)).alias("cumulative_index"),
    )
    return indexed.withColumn("cumulative_return", F.col("cumulative_index") - F.lit(1.0))


def versions(dim: DataFrame, key: str = "ticker", order: str = "valid_from") -> DataFrame:
    """Number the rows of each key in order."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return dim.withColumn("rn", position.cast("bigint"))


def next_version(dim: DataFrame, key: str = "ticker", version: str = "version_number") -> DataFrame:
    """The version number each key's next change would get."""
    return dim.groupBy(key).agg((F.max(version) + F.lit(1)).alias("next_version"))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each key: a partial aggregate, no sort and no window."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def deepest_per_key(df: DataFrame, key: str, depth: str) -> DataFrame:
    """The row with the largest depth of each key."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(depth)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )
