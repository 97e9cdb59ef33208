"""Aggregates that reports share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_and_span(df: DataFrame, keys: Sequence[str], time_column: str = "timestamp_utc") -> DataFrame:
    """Rows, first and last time per key; partial sums are made before the shuffle."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempt_count"), F.min(time_column).alias("first_attempt"),
        F.max(time_column).alias("last_attempt"))


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Keys with at least ``n`` rows (GROUP BY ... HAVING)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)


def severity_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One column per severity, zero where there is none."""
    return df.groupBy(*keys).agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low", "info")])


def representative(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column | str]
                   ) -> DataFrame:
    """Columns of one pinned row per group, where SQLite would pick any row."""
    row = F.min_by(F.struct(*columns), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])


def ordered_members(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                    limit: int | None = None) -> DataFrame:
    """Members of every group in order, as an array, with their number ``members``.

    The array is one value of the result, so a group must fit into a row.  Where it may not, ``limit`` leaves the arrays of
    larger groups null, before their rows are gathered; the count stays exact and the members are the rows of ``df``.
    """
    from fleetlens.operators.joins import salted_join

    entry = F.struct(*order, F.col(value).alias("__value"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    if limit is None:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("members"),
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["__value"]).alias("ordered"))
    short = sizes.filter(F.col("members") <= limit).select(*keys)
    lists = (salted_join(df.select(*keys, *{*order, value}), short, list(keys), "left_semi").groupBy(*keys)
             .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["__value"]).alias("ordered")))
    return sizes.join(lists, list(keys), "left")


def distinct_text(df: DataFrame, keys: Sequence[str], column: str, name: str,
                  limit: int | None = None, separator: str = ",") -> DataFrame:
    """Sorted distinct values per key as one text, with their exact number ``n_<name>``.

    Values are made distinct per (key, value) first, so repetitions of a hot key vanish before the shuffle.  The text is one
    value of the result; ``limit`` leaves it null for keys with more values, of which ``distinct_pairs`` has all.
    """
    pairs = distinct_pairs(df, keys, column)
    whole = F.array_join(F.array_sort(F.collect_list(column)), separator).alias(name)
    if limit is None:
        return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), whole)
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    short = sizes.filter(F.col(f"n_{name}") <= limit).select(*keys)
    lists = (pairs.join(short, list(keys), "left_semi").groupBy(*keys)
             .agg(whole))
    return sizes.join(lists, list(keys), "left")


def distinct_pairs(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
