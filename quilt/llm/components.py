"""Connected components of a table of links, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import save


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: every larger neighbour of a node moves to the
    node's least neighbour; small: every smaller neighbour (and the node) does.
    The least neighbour is an aggregate with a partial step and comes back by a
    join whose hot keys AQE can split, so a hub never gathers its neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = (
            edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), "b"))
        )
    return moved.where("a < b").distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node of a
    link other than the root itself. Null ends and self-links are ignored; an
    empty table gives an empty result."""
    edges = save(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where("a < b").distinct()
    )

    def mark(df: DataFrame):
        return tuple(df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first())

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = save(_stars(_stars(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
