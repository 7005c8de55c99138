"""Connected components by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthound.session import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): each node's neighbours move to its smallest neighbour (or to itself, if that is smaller)."""
    both = edges.select("u", "v").union(edges.select("v", "u").toDF("u", "v")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    out = moved.filter("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, label): label is the smallest node that links (a, b) reach; nodes without a link are absent.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of a component's diameter.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v"), "edges")
    before = None
    for _ in range(most):
        edges = written(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct().toDF("node", "label")).distinct()
