"""Return and compounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.model import RETURN_FLOOR


def simple_return(value: Column, previous: Column) -> Column:
    """Relative change; NULL when there is no previous value or it is zero."""
    return value / F.nullif(previous, F.lit(0.0)) - F.lit(1.0)


def log_return(value: Column, previous: Column) -> Column:
    """Log of the ratio; NULL where the ratio has no logarithm."""
    ratio = value / F.nullif(previous, F.lit(0.0))
    return F.when(ratio > 0, F.ln(ratio))


def guarded_growth(ret: Column) -> Column:
    """``ln(1 + r)`` with a floor that keeps a total loss finite."""
    return F.ln(F.lit(1.0) + F.greatest(ret, F.lit(RETURN_FLOOR)))


def compound(ret: Column, where: Column | None = None) -> Column:
    """Aggregate: total return of a series of period returns.

    NULL when no row qualifies.
    """
    growth = guarded_growth(ret)
    if where is not None:
        growth = F.when(where, growth)
    return F.exp(F.sum(growth)) - F.lit(1.0)


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded percentage; NULL on an empty whole."""
    return F.round(
        F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits
    )


def rounded(value: Column, digits: int = 6) -> Column:
    """Round and turn negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)
