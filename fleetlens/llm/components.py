"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of an edge (bigint columns ``a``, ``b``).

    Alternating star operations: every node hands its larger neighbours, then its smaller ones, to the smallest it
    knows, which ends after logarithmically many rounds.  The smallest neighbour comes from an aggregate and a join,
    so that a node with very many neighbours is never one task's.  Each round is written once; the driver sees a
    count and a checksum per round.
    """
    a_col, b_col = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    stars = (edges.filter(a_col != b_col)
             .select(F.greatest(a_col, b_col).alias("u"), F.least(a_col, b_col).alias("v")).distinct())
    stars = cut_lineage(stars)
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        stars = cut_lineage(small)
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
