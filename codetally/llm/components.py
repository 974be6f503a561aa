"""Connected components of a link table, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetally.llm.storage import drop_staged, stage


def connected_components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component`` for every node with a link to another node.

    ``component`` is the smallest node that can be reached. Links have no
    direction; repeated links, links of a node to itself and links with a null
    end change nothing. An empty table gives an empty table.

    Alternates the large-star and small-star steps: every node hands the smallest
    node it knows to its neighbours, which ends, after few rounds even for long
    chains, in one star per component. The smallest neighbour comes from a
    partially aggregated sum per node and is joined back, so that no node's
    neighbours are gathered anywhere; AQE splits the join of a node that has very
    many. Each round is a table in the shared folder.
    """
    a, b = F.col(src), F.col(dst)
    edges = stage(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_staged(edges)
        edges = following
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
