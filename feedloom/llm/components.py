"""Connected components of links between rows, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of ``links`` (u, v).

    Rounds replace links by links to the least neighbour until every node links to the
    least of its component. Each half round is written to the shared folder: a minimum
    is aggregated on the map side first, and the join that hands it to a hot node's many
    neighbours reads two stored tables, so Spark can split it. A link with a null end
    counts for nothing.
    """
    edges = stored(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if not state[0] or state == before:
            break
        before = state
        # Large star: each larger neighbour is linked to the least of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(
            both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-least"
        )
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(larger.distinct(), "links-large")
        # Small star: the smaller neighbours, and the node itself, to the least of them.
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        smaller = edges.join(least, "u").select("u", "v", "m")
        moved = smaller.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = stored(moved.unionByName(own).distinct(), "links-small")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots.distinct())
