"""Connected components of a graph that lives in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronoframe.llm.storage import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node reachable.

    Alternates two star steps (Kiveris et al., 2014). A node's smallest neighbour
    comes from a pre-aggregated minimum and is joined back, so a node with very
    many neighbours is never gathered; each round is written to the shared folder.
    Links of a node to itself and repeated links are allowed; nulls are not.
    """
    edges = stored(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        edges = stored(
            small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
            .observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links"
        )
        after = (seen.get["n"], seen.get["h"])
        if after == before or after[0] == 0:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
