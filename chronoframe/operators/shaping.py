"""Projections, filters, ordering and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions import starts
from chronoframe.model import ReportingWindow


def select_as(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select ``source -> alias`` pairs."""
    return df.select([F.col(source).alias(alias) for source, alias in mapping.items()])


def in_window(df: DataFrame, time: str, window: ReportingWindow) -> DataFrame:
    return df.filter(window.contains(F.col(time)))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows where every named column has a value."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def label_in_range(df: DataFrame, label: str, time: str, value: str, window: ReportingWindow) -> DataFrame:
    return df.filter((F.col(label) == F.lit(value)) & window.contains(F.col(time)))


def from_start(df: DataFrame, time: str, start: str) -> DataFrame:
    """Keep rows on or after the day held in another column."""
    return df.filter(F.col(time) >= F.col(start))


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def only(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def starting_with(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(starts(F.col(column), prefix))


def basis(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("join_basis") == F.lit(name))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def to_bases(df: DataFrame, bases: Mapping[str, str], label: str, keep: Sequence[str]) -> DataFrame:
    """Turn one label column per basis into rows tagged with the basis; one scan."""
    pairs = ", ".join(f"'{name}', `{column}`" for name, column in bases.items())
    return df.select(
        *keep, F.expr(f"stack({len(bases)}, {pairs}) as (join_basis, {label})")
    )


def largest_first(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column))


def top_n(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The n rows with the largest value; rows without a value never qualify.

    ``tie`` orders equal values, so that the answer is the same on every run.
    """
    return require(df, column).orderBy(F.desc(column), F.asc(tie)).limit(n)


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def sorted_labels(df: DataFrame, label: str) -> DataFrame:
    return distinct_keys(df, label).orderBy(label)


def in_order(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Restrict to a shortlist and sort in the order of that shortlist."""
    rank = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return only(df, column, values).withColumn("display_order", rank.cast("int")).orderBy("display_order")
