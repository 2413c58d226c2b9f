"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.lineage import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Rounds of two steps: each node hands its larger neighbours its smallest one, then its
    smaller neighbours. Edges never grow in number, and stars are left when no round changes
    them. Rounds grow with the logarithm of the nodes. Every round is a table in the shared
    folder, so a lost executor repeats one round. A node with many neighbours is reduced
    before the shuffle, and its edges are spread by the skewed-join splitting.

    Null ends and loops are left out, unless a loop is all a node has: then it is its own component.
    """
    pairs = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"), "edges")
    alone = pairs.where("u = v").select("u").distinct()
    now = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_stars(_large_stars(now)), "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
    lone = alone.join(found, alone["u"] == found["node"], "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.union(lone)


def _large_stars(edges: DataFrame) -> DataFrame:
    """Edges (u > v): each larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Edges (u > v): a node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
