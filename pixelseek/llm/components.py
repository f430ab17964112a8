"""Connected components of a graph kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours on one side of it are linked to the smallest of its neighbourhood.

    large: the neighbours larger than the node, small: the smaller ones and the node itself. Minimum and neighbours come
    from aggregation and a join, so no node's neighbourhood has to fit into one row or task."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["w"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node of its component.

    Alternates large-star and small-star until nothing changes; every round is written to the shared folder, so a lost
    executor costs no more than the round. Nothing but two numbers a round reaches the driver. Links to oneself, null
    ends and repeated links are ignored; an empty table gives an empty one."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
        # Equal count and sum of hashes of two rounds: the same edges.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
