"""Duplicates and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per event_hash.  Copies can differ in parser fields; the smallest parser name stays.

    An aggregate, not a window: each task sends at most one row per hash, so a third of all rows being
    copies of one line costs nothing extra.
    """
    columns = events.columns
    order = F.struct("parser_name", "parser_version", *[c for c in ("description", "notes") if c in columns])
    return (events.groupBy("event_hash")
            .agg(F.min_by(F.struct(*columns), order).alias("__row"))
            .select("__row.*"))


def only_new(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose hash is not in the store yet."""
    return events.join(stored.select("event_hash").distinct(), "event_hash", "left_anti")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys do not occur in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def both_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with ``side`` = left or right; one shuffle for both directions."""
    tagged = (left.select(*keys).withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0))
              .unionByName(right.select(*keys).withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1))))
    seen = tagged.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return (seen.filter(F.col("__l") != F.col("__r"))
            .select(*keys, F.when(F.col("__l") == 1, "left").otherwise("right").alias("side")))
