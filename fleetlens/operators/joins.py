"""Join patterns: salted semi joins and time-interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.times import micros
from fleetlens.operators.windows import HOUR_MICROS, chunked_scan

MINUTE_MICROS = 60_000_000
SALTS = 16
#: Tasks of a join whose rows are pairs, per core or shuffle partition.
TASKS_PER_SLOT = 4
#: Buckets that a window's length is cut into for such a join.
BUCKETS = 6


def _spread(df: DataFrame, salts: int) -> DataFrame:
    """A copy of every row per salt, so that each part of a hot key finds its partner."""
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                *, salts: int = SALTS) -> DataFrame:
    """Equi join whose left side may have hot keys; ``right`` has at most a few rows per key.

    ``how`` is inner, left, left_semi or left_anti: in each of them every left row meets all partners,
    because the right side is repeated once per salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    return (_salt(left, salts).join(_spread(right, salts), [*keys, "__salt"], how).drop("__salt"))


def within_minutes(anchors: DataFrame, events: DataFrame, minutes: float, *, keys: Sequence[str] = (),
                   before: bool = True, after: bool = True, time_column: str = "timestamp_utc") -> DataFrame:
    """Pairs of anchor and event at most ``minutes`` apart, both ends included.

    Events carry the columns of the anchors' partner; anchor columns must be named apart (``anchor_ts`` is
    the anchor time).  Time is cut into buckets of a sixth of the window length, so that Spark joins on equality of
    (keys, bucket) and only compares times inside the buckets that a window touches.

    Rows are pairs, whose number grows with the square of what shares a bucket.  The buckets are dealt over a stated
    number of tasks, several per core, because adaptive execution would join them by the bytes of the narrow inputs;
    a task holds the events of one bucket at a time and spills them, never the pairs.
    """
    spark = anchors.sparkSession
    tasks = TASKS_PER_SLOT * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = int(minutes * MINUTE_MICROS)
    anchor_us, event_us = micros(F.col("anchor_ts")), micros(F.col(time_column))
    bucket = lambda at: F.floor(at / F.lit(max(1, -(-width // BUCKETS))))
    first, last = (F.col("__anchor_us") + shift for shift in (-width if before else 0, width if after else 0))
    left = (anchors.filter(F.col("anchor_ts").isNotNull()).withColumn("__anchor_us", anchor_us)
            .withColumn("__bucket", F.explode(F.sequence(bucket(first), bucket(last)))))
    right = (events.filter(F.col(time_column).isNotNull()).withColumn("__event_us", event_us)
             .withColumn("__bucket", bucket(F.col("__event_us"))))
    gap = F.col("__event_us") - F.col("__anchor_us")
    near = gap.between(-width if before else 0, width if after else 0)
    left, right = (side.repartition(tasks, *keys, "__bucket") for side in (left, right))
    return (left.join(right, [*keys, "__bucket"], "inner").filter(near)
            .drop("__bucket", "__anchor_us", "__event_us"))


def look_along_time(
    anchors: DataFrame,
    items: DataFrame,
    *,
    anchor_id: str,
    keys: Sequence[str],
    instants: dict[str, Column],
    item_time: Column,
    sums: dict[str, Column],
    item: Column | None = None,
    item_tie: str = "event_hash",
    width: int = HOUR_MICROS,
) -> DataFrame:
    """What lies on the time line of an anchor's keys at some instants, without building pairs.

    The result has the anchors' columns and, per name in ``instants`` (microseconds), a struct with

    * every name in ``sums``: the total over all items up to and including the instant,
    * ``last``: the latest item up to and including the instant,
    * ``next``: the earliest item after it (both STRUCT<at, item>; only where ``item`` is given and not null).

    A count over an interval is the difference of two totals, and an as-of lookup is ``last`` or ``next``.
    Items become running values of :func:`chunked_scan`, so neither a hot key nor a long interval gathers
    in one task, and the cost does not depend on how many items an interval holds.
    """
    keys, names = list(keys), list(sums)
    values = [F.sum(v).alias(n) for n, v in sums.items()]
    if item is not None:
        entry = F.struct(item_time.cast("long").alias("at"), item.alias("item"))
        tie = F.when(item.isNotNull(), F.col(item_tie))
        values += [F.min_by(entry, tie).alias("__lowest"), F.max_by(entry, tie).alias("__highest")]
    # One row per key and instant, combined before the shuffle: many items at one instant cost one row.
    points = (items.filter(item_time.isNotNull()).groupBy(*keys, item_time.cast("long").alias("__t"))
              .agg(*values))
    # Whole numbers stay within 64 bits; decimal sums keep their own width.
    kinds = {n: "decimal(38,0)" if points.schema[n].dataType.typeName() == "decimal" else "long" for n in names}
    points = points.withColumns({n: F.col(n).cast(k) for n, k in kinds.items()})
    carried_names = [c for c in points.columns if c in ("__lowest", "__highest")]
    anchor = F.struct(*anchors.columns)
    probes = anchors.select(
        *keys, anchor.alias("__anchor"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), t.cast("long").alias("t"))
                            for n, t in instants.items()])).alias("__p"))
    probes = probes.filter(F.col("__p.t").isNotNull()).select(
        *keys, F.col("__p.t").alias("__t"), F.lit(1).alias("__probe"), "__anchor",
        F.col("__p.name").alias("__name"),
        *[F.lit(0).cast(kinds[n]).alias(n) for n in names],
        *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried_names])
    data = points.select(
        *keys, "__t", F.lit(0).alias("__probe"),
        F.lit(None).cast(probes.schema["__anchor"].dataType).alias("__anchor"),
        F.lit(None).cast("string").alias("__name"), *names, *carried_names)
    # At one instant the items come before the probe.
    scanned = chunked_scan(
        data.unionByName(probes), keys, F.col("__t"), ["__probe"], width=width, peers=True,
        sums={f"__run_{n}": F.col(n) for n in names},
        carried={"__last": F.col("__highest")} if carried_names else None,
        upcoming={"__next": F.col("__lowest")} if carried_names else None)
    seen = [F.col(f"__run_{n}").alias(n) for n in names]
    if carried_names:
        seen += [F.col("__last").alias("last"), F.col("__next").alias("next")]
    per_anchor = (scanned.filter(F.col("__probe") == 1)
                  .groupBy(F.col("__anchor").getField(anchor_id).alias(anchor_id))
                  .agg(F.any_value("__anchor").alias("__anchor"),
                       *[F.any_value(F.when(F.col("__name") == n, F.struct(*seen)), F.lit(True)).alias(n)
                         for n in instants]))
    return per_anchor.select("__anchor.*", *instants)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (a global aggregate has exactly one row)."""
    return (df.withColumn("__one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one").drop("__one"))
