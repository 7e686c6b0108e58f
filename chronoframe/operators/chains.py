"""Version-chain walks: each key's versions as a path.

A dimension is a linked list per key. The walks are expressed as ordered
windows, so the depth is not limited and every key is walked in the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import open_end_label

ARROW = " -> "


def _walk(dim: DataFrame, key: str, label: str, of) -> DataFrame:
    """Depth and the label before, per version; for one chosen key also the path up to it.

    Per version and key the path would grow with the square of the versions;
    ``all_chains`` has it once per key.
    """
    history = Window.partitionBy(key).orderBy("valid_from")
    walked = dim.select(
        "*", F.row_number().over(history).alias("depth"), F.lag(label).over(history).alias("previous_label")
    )
    if of is None:
        return walked
    so_far = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return walked.withColumn("sector_path", F.array_join(F.collect_list(label).over(so_far), ARROW))


def _shown(walked: DataFrame, key: str, labels: list[str], of) -> DataFrame:
    """In order of depth; a single walk is sorted as one, others within their key."""
    path = [] if of is None else ["sector_path"]
    return walked.select(
        key,
        "depth",
        *labels,
        "previous_label",
        "valid_from",
        open_end_label(F.col("valid_to")).alias("valid_to"),
        "change_reason",
        *path,
    ).orderBy(*([key] if of is None else []), "depth")


def chain_successor(dim: DataFrame, *, key: str = "ticker", label: str = "gics_sector", of=None) -> DataFrame:
    """Each version with its depth and the label before it; gaps are stepped over.

    The successor of a version is the one with the smallest later start. ``of``
    restricts the walk to one key, before the window, and adds the path.
    """
    chosen = dim if of is None else dim.filter(F.col(key) == F.lit(of))
    return _shown(_walk(chosen, key, label, of), key, [label], of)


def chain_calendar(
    dim: DataFrame, *, key: str = "ticker", label: str = "gics_sector", sub_label: str = "gics_sub_industry", of=None
) -> DataFrame:
    """The walk that demands calendar adjacency: it stops at the first gap.

    A diagnostic. A change over a weekend stops it although no observed day is
    missing.
    """
    chosen = dim if of is None else dim.filter(F.col(key) == F.lit(of))
    history = Window.partitionBy(key).orderBy("valid_from")
    so_far = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = F.date_add(F.lag("valid_to").over(history), 1)
    adjacent = F.col("version_number").eqNullSafe(1) | F.coalesce(F.col("valid_from") == expected, F.lit(False))
    linked = _walk(chosen.withColumn("_adjacent", adjacent), key, label, of)
    reached = linked.withColumn("_reached", F.min("_adjacent").over(so_far)).filter("_reached")
    return _shown(reached, key, [label, sub_label], of)


def all_chains(dim: DataFrame, *, key: str = "ticker", label: str = "gics_sector") -> DataFrame:
    """One row per key with more than one version: its depth and full path.

    The list holds one entry per version of one key, at most one per day.
    """
    ordered = F.array_sort(F.collect_list(F.struct("valid_from", label)))
    return (
        dim.groupBy(key)
        .agg(ordered.alias("_history"))
        .filter(F.size("_history") > 1)
        .select(
            key,
            F.size("_history").alias("versions"),
            F.array_join(F.col(f"_history.{label}"), ARROW).alias("sector_path"),
        )
    )
