"""Connected components of a link table, by alternating large and small stars.

Every round is two groupings by minimum (combined before the shuffle) and two
equi-joins, so a hub that holds a third of all links is split by adaptive
execution instead of landing in one task.  Nothing but two counters per round
reaches the driver.  Rounds are cut by tables in the shared folder; a round's
tables go when the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, table


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "p").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``; root is the smallest node reachable.

    Only nodes that occur in a link between two different nodes are returned.
    Null ends, self links and repeated links are allowed and mean nothing.
    """
    edges = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p"))
        .distinct()
    )
    edges = table(edges, "links")
    before = _signature(edges)
    while before[0]:
        both = edges.select("v", "p").unionByName(edges.select(F.col("p").alias("v"), F.col("v").alias("p")))
        low = both.groupBy("v").agg(F.min("p").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (
            both.join(low, "v").where(F.col("p") > F.col("v")).select(F.col("p").alias("v"), F.col("m").alias("p")).distinct()
        )
        large = table(large, "large-star")
        low = large.groupBy("v").agg(F.min("p").alias("m"))
        small = (
            large.join(low, "v")
            .where(F.col("p") != F.col("m"))
            .select(F.col("p").alias("v"), F.col("m").alias("p"))
            .unionByName(low.select("v", F.col("m").alias("p")))
            .distinct()
        )
        old, edges = edges, table(small, "small-star")
        drop(old, large)
        after = _signature(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("v").alias("node"), F.col("p").alias("root"))
    return leaves.unionByName(edges.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
