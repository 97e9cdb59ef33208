"""Groups of rows that share one of two keys, directly or through others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage


def linked_groups(pairs: DataFrame, scope: Sequence[str], a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """((scope, a, group), (scope, b, group)): values of two columns that occur together, in the same group of their scope.

    Each different pair hands the smallest name it knows to its partners, in turn by either column, until none changes; that
    takes as many rounds as the longest chain of partners.  Only pairs take part, not their rows; the driver sees one number
    per round.
    """
    scope = list(scope)
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*scope, a, b).distinct()
    edges = cut_lineage(known.withColumn("group", F.col(b)))
    while True:
        after = edges.withColumn("before", F.col("group"))
        for side in (a, b):
            least = after.groupBy(*scope, side).agg(F.min("group").alias("least"))
            after = after.join(least, [*scope, side]).withColumn("group", F.col("least")).drop("least")
        after = cut_lineage(after)
        changed = after.agg(F.count_if(F.col("group") != F.col("before"))).first()[0]
        edges = after.drop("before")
        if not changed:
            break
    return tuple(edges.groupBy(*scope, side).agg(F.min("group").alias("group")) for side in (a, b))
