"""Column expressions. Everything stays inside whole-stage code generation."""

from chronoframe.functions.labels import (
    blank_to_null,
    differs,
    distinct_from,
    normalise_key,
    open_end_label,
    opening_value,
    padded_identifier,
    polarity,
    present,
    starts,
    tagged,
)
from chronoframe.functions.measures import (
    compound,
    guarded_growth,
    log_return,
    pct,
    rounded,
    simple_return,
)
from chronoframe.functions.validity import (
    covers,
    day_of,
    effective_end,
    overlaps_window,
    violates_lifetime,
    violation_kind,
)

__all__ = [
    "blank_to_null", "compound", "covers", "day_of", "differs", "distinct_from", "effective_end",
    "guarded_growth", "log_return", "normalise_key", "open_end_label",
    "opening_value", "overlaps_window", "padded_identifier", "pct", "polarity", "present",
    "rounded", "simple_return", "starts", "tagged", "violates_lifetime", "violation_kind",
]
