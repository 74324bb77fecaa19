"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least node next to it.

    The least neighbour is an aggregate that combines in each task and comes back by a join, which adaptive execution splits
    where one node has very many links; no node's neighbours are gathered.
    """
    ways = edges.select("a", "b")
    if large:
        ways = ways.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = ways.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` of every node with a link to another one; the component is its least node.

    ``links`` has two long columns ``a, b``; order, repeats, loops and null ends do not matter.  Each round is written to the
    shared folder.  An empty link table gives no rows.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(pairs, "links")
    mark = None
    for _ in range(rounds):
        edges = stored(_star(_star(edges, large=True), large=False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # Edges now lead from every node to the least node of its component.
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
