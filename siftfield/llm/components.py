"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfield.llm.common import spread, written

MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over edges (a > b): hang neighbours on the smallest one around each node.

    The smallest neighbour is grouped with map-side partial results and joined back, so neighbour
    lists are never gathered; a node with very many links is split by the adaptive planner.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(spread(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(spread(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link; the root is the smallest node of the component.

    ``links``: a, b (long), in any order, repeats and loops allowed.  Every round's edges are written
    to the shared folder; their number never grows beyond that of the links and nodes.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(MOST_ROUNDS):
        edges = written(_stars(_stars(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError("the components did not settle")
