"""Ordered scans that do not put a whole key into one task.

A plain window sorts all rows of its partition key in one task.  Here the order is cut into chunks: a window
runs inside each (key, chunk), one small row per chunk is scanned per key, and its result is joined back as
the starting value.  A log file or address that holds a third of all rows is thereby spread over as many
tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetlens.session import cut_lineage

HOUR_MICROS = 3_600_000_000
_CHUNK = "__chunk"


def chunked_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    ties: Sequence[str] = (),
    *,
    width: int = HOUR_MICROS,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    carried: dict[str, Column] | None = None,
    carried_before: dict[str, Column] | None = None,
    upcoming: dict[str, Column] | None = None,
    peers: bool = False,
) -> DataFrame:
    """Add running values per key in the order of ``order`` (a whole number), then ``ties``.

    ``sums``            running totals, this row included
    ``lags``            value of the previous row
    ``carried``         last non-null value, this row included
    ``carried_before``  last non-null value of earlier rows
    ``upcoming``        first non-null value, this row included
    ``width``           length of a chunk in units of ``order``; any value gives the same result
    ``peers``           totals take in all rows with the same ``order`` value (a RANGE frame)

    Rows with a null key take no part.
    """
    sums, lags = sums or {}, lags or {}
    carried, carried_before = carried or {}, carried_before or {}
    carries, upcoming = {**carried, **carried_before}, upcoming or {}
    keys = list(keys)

    work = df.withColumn("__order", order.cast("long"))
    work = work.select("*", *[v.alias(f"__in_{n}") for n, v in {**sums, **lags, **carries, **upcoming}.items()],
                       F.floor(F.col("__order") / F.lit(width)).alias(_CHUNK))

    position = F.struct("__order", *ties)
    inside_keys = [*keys, _CHUNK]
    aggregates = [F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in sums]
    aggregates += [F.max_by(F.struct(f"__in_{n}"), position).alias(f"__last_{n}") for n in lags]
    aggregates += [
        F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), position)).alias(f"__last_{n}")
        for n in carries]
    aggregates += [
        F.min_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), position)).alias(f"__first_{n}")
        for n in upcoming]
    summary = work.groupBy(*inside_keys).agg(*aggregates)

    over_chunks = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_CHUNK)
    earlier = over_chunks.rowsBetween(W.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__start_{n}") for n in sums]
    starts += [F.lag(f"__last_{n}").over(over_chunks).getField(f"__in_{n}").alias(f"__start_{n}")
               for n in lags]
    starts += [F.last(f"__last_{n}", ignorenulls=True).over(earlier).alias(f"__start_{n}") for n in carries]
    later = over_chunks.rowsBetween(1, W.unboundedFollowing)
    starts += [F.first(f"__first_{n}", ignorenulls=True).over(later).alias(f"__start_{n}") for n in upcoming]
    # Join and window share the partitioning (keys, chunk): the rows are shuffled once for both.
    joined = work.join(summary.select(*inside_keys, *starts), inside_keys, "inner")

    inside = W.partitionBy(*inside_keys).orderBy("__order", *ties)
    if peers:
        up_to_here = W.partitionBy(*inside_keys).orderBy("__order").rangeBetween(W.unboundedPreceding, 0)
    else:
        up_to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = {}
    for n in sums:
        out[n] = F.sum(f"__in_{n}").over(up_to_here) + F.col(f"__start_{n}")
    for n in lags:
        out[n] = F.when(F.row_number().over(inside) == 1, F.col(f"__start_{n}")) \
            .otherwise(F.lag(f"__in_{n}").over(inside))
    for n in carried:
        out[n] = F.coalesce(
            F.last(f"__in_{n}", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)),
            F.col(f"__start_{n}"))
    for n in carried_before:
        out[n] = F.coalesce(F.last(f"__in_{n}", ignorenulls=True).over(before), F.col(f"__start_{n}"))
    for n in upcoming:
        out[n] = F.coalesce(
            F.first(f"__in_{n}", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)),
            F.col(f"__start_{n}"))
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[value.alias(name) for name, value in out.items()])


def stitch_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, *, width: int) -> DataFrame:
    """Number the runs of equal consecutive ``value`` per key (gaps and islands) as ``run_id``."""
    marked = chunked_scan(df, keys, F.col(order), width=width, lags={"__previous": F.col(value)})
    starts = F.when(F.col("__previous").eqNullSafe(F.col(value)) & F.col("__previous").isNotNull(), 0) \
        .otherwise(1)
    return chunked_scan(marked, keys, F.col(order), width=width, sums={"run_id": starts}).drop("__previous")


def fifo_pairs(df: DataFrame, keys: Sequence[str], order: Column, is_open: Column, ties: Sequence[str],
               *, width: int = HOUR_MICROS) -> DataFrame:
    """Number opens and closes per key so that the k-th open belongs to the k-th usable close.

    Adds ``pair_no``: for an open its rank, for a close the rank of the open it ends, null for a close that
    no open is waiting for.  At equal times opens come first.  The balance of opens minus closes, reflected
    at zero, decides which closes are usable: a close that takes the plain balance to a new minimum below
    zero is not.
    """
    keys = list(keys)
    work = (df.withColumn("__order", order.cast("long")).withColumn("__close", F.when(is_open, 0).otherwise(1)))
    step = F.when(F.col("__close") == 0, 1).otherwise(-1)
    scanned = chunked_scan(
        work, keys, F.col("__order"), ["__close", *ties], width=width,
        sums={"__balance": step, "__opens": 1 - F.col("__close"), "__closes": F.col("__close").cast("long")})
    # Running minimum of the balance: the same two steps, with min in place of sum.
    scanned = scanned.withColumn(_CHUNK, F.floor(F.col("__order") / F.lit(width)))
    lows = scanned.groupBy(*keys, _CHUNK).agg(F.min("__balance").alias("__low"))
    over_chunks = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    lows = lows.select(*keys, _CHUNK, F.min("__low").over(over_chunks).alias("__start_low"))
    inside = W.partitionBy(*keys, _CHUNK).orderBy("__order", "__close", *ties)
    zero = F.lit(0).cast("long")
    upto = F.min("__balance").over(inside.rowsBetween(W.unboundedPreceding, 0))
    earlier = F.min("__balance").over(inside.rowsBetween(W.unboundedPreceding, -1))
    low_now = F.least(zero, upto, F.coalesce(F.col("__start_low"), zero))
    low_before = F.least(zero, F.coalesce(earlier, zero), F.coalesce(F.col("__start_low"), zero))
    # Each unusable close lowers the minimum by one, so minus the minimum counts them.
    pair_no = (F.when(F.col("__close") == 0, F.col("__opens"))
               .when(low_now < low_before, F.lit(None).cast("long"))
               .otherwise(F.col("__closes") + low_now))
    return (scanned.join(lows, [*keys, _CHUNK], "inner")
            .select(*df.columns, pair_no.alias("pair_no")))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
                    ) -> DataFrame:
    """First row of every group as an aggregate, so that only one row per task and group is shuffled."""
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first"))
            .select(*keys, *[F.col("__first").getField(c).alias(c) for c in columns if c not in keys]))


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows of every group, with their rank as ``rank_in_group``.

    Spark cuts each map task down to n rows per group before the shuffle (window group limit, n up to
    1000), so a hot group arrives small.
    """
    ranked = df.withColumn("rank_in_group", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank_in_group") <= n)


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their number from 1 in a total order, without one task for all.

    Range partitions are sorted and written once; a number is the place in its partition plus the rows of the
    partitions before, of which there is one count each.
    """
    ranged = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first")).select(
        "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (ranged.join(starts, "__part")
            .withColumn(name, F.col("__place") - F.col("__first") + F.col("__start") + 1)
            .drop("__part", "__place", "__first", "__start"))
