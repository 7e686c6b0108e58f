"""Readers. Every one returns typed frames; nothing is inferred from the data."""

from chronoframe.sources.prices import Landing, corpus_profile, parse_lines, read_keyed_csv
from chronoframe.sources.reference import (
    holdouts_from_lines,
    idle_changes,
    intervals_from_text,
    land_seed,
    lines_to_rows,
    log_from_text,
    read_change_log,
    read_holdouts,
    read_intervals,
    read_registry,
    read_seed,
    read_snapshot,
    read_table,
    registry_from_lines,
    snapshot_from_text,
    validate_changes,
)

__all__ = [
    "Landing", "corpus_profile", "holdouts_from_lines", "idle_changes", "intervals_from_text", "land_seed", "lines_to_rows", "log_from_text", "parse_lines", "read_change_log", "read_holdouts", "read_intervals",
    "read_keyed_csv", "read_registry", "read_seed", "read_snapshot", "read_table",
    "registry_from_lines", "snapshot_from_text", "validate_changes",
]
