"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps the components and moves every node nearer to its component's smallest node; when a round changes
nothing the edges are stars around those. The number of rounds grows with the logarithm of the longest path.

The neighbours of a node meet its smallest one in a join by that node; of a giant component's root they are very many.
Smallest neighbours come from a partial aggregate, and the join's skewed partitions are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (``large``) or other neighbours to the smallest node around it."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # from the larger end to the smaller
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = near.join(least, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``u, v``, of an ordered type), the root its component's
    smallest node. Loops and repeated edges are allowed; no edges give no rows."""
    edges = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = written(_stars(_stars(edges, True), False), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
