"""Registration of a query together with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions import rounded
from queries.ctes import with_ctes
from queries.mapping import Inputs

DIGITS = 6


class Family:
    def __init__(self) -> None:
        self.runs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, select: str, *ctes: str, recursive: bool = False):
        """Register the decorated function under its name, with an oracle over the named CTEs."""

        def keep(build: Callable[[Inputs], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return round_doubles(build(Inputs(spark, sf_dir)))

            self.runs[build.__name__] = run
            self.oracles[build.__name__] = with_ctes(select, *ctes, recursive=recursive)
            return build

        return keep


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every double, so that the order of summation does not show."""
    if not any(f.dataType == T.DoubleType() for f in df.schema.fields):
        return df
    return df.select(
        [
            rounded(F.col(f.name), DIGITS).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str, alias: str | None = None) -> str:
    """The same rounding in SQL."""
    return f"round({expression}, {DIGITS}) + 0.0::DOUBLE AS {alias or expression}"


def rs(*columns: str) -> str:
    return ", ".join(r(c) for c in columns)
