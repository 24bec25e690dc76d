"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved


def _star(edges: DataFrame, path: str, large: bool) -> DataFrame:
    """Link every node's neighbours to the least of them. ``large`` moves greater neighbours,
    else the node itself moves with its smaller ones. The least neighbour is combined before
    the shuffle, and both sides of the join are plain tables, so that Spark can split a hub."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = saved(near.distinct(), f"{path}-near")
    least = saved(
        near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{path}-least"
    )
    joined = near.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return saved(moved.where(F.col("a") != F.col("b")).distinct(), path)


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the root is the least node that can
    be reached. Every round is written to ``folder``; only its size and a checksum reach the
    driver. No links give no rows."""
    edges = saved(links.where(F.col("a") != F.col("b")).distinct(), f"{folder}/links")
    before, turn = None, 0
    while True:
        edges = _star(edges, f"{folder}/large-{turn}", large=True)
        edges = _star(edges, f"{folder}/small-{turn}", large=False)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, turn = state, turn + 1
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
