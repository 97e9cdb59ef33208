"""Mix sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.tables import WORD, fresh, whole_text
from fleetlens.session import cut_lineage

SLICE_ROWS = 4096


def source_sizes(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: n_docs, source_size."""
    return sized.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).cast("long").alias("source_size"))


def fill_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of a table (source, source_size, weight): adds ``target``, and ``epochs`` = target / source_size.

    All sources together keep the words they have.  Each round gives the open sources the rest by weight;
    those above ``max_epochs`` times their size are clamped there, and the excess goes to the others, until no
    source is above.  Sources without words, and weights that are null, zero or negative, get nothing.
    A round is one aggregate over the source table, of which the driver sees two sums and a count.
    """
    # The source table has one row per entry of the mixing recipe, so it is written once and read per round.
    table = cut_lineage(sources.withColumn(
        "weight", F.when(F.col("source_size") > 0, F.greatest(F.col("weight").cast("double"), F.lit(0.0)))
        .otherwise(0.0)).withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    cap = F.col("source_size") * float(max_epochs)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # A source is clamped if the level (words per unit of weight) lifts it above its cap; levels only rise.
        clamped = (F.col("weight") > 0) & (F.col("weight") * F.lit(level) > cap)
        fixed, open_weight, count = table.agg(
            F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight"))),
            F.count(F.when(clamped, 1))).first()
        if not open_weight:
            break
        new_level = (total - (fixed or 0.0)) / open_weight
        if new_level <= level:
            break
        level = new_level
    target = F.least(F.col("weight") * F.lit(level), cap)
    return table.select(
        *sources.columns, target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("epochs"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "mix",
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of ``docs`` with size, source_size, target and taken.

    ``weights`` has (source, weight); without it the sources, in code point order with null last, weigh
    1, 2, 3, 1, 2, 3, ...  ``size`` counts the runs of non-blank characters (null or empty text: 0).

    A source at ``epochs`` = e gives every document floor(e) times, and e - floor(e) of its words a further time:
    documents go in the order of a seeded digest of their key until that share is reached, the last one in part.
    So a source meets its target to a word, a document is taken at most ceil(e) times, and a rerun takes the same.

    The order within a source is never one window: digests are cut into as many equal slices as the source has
    thousands of documents, slice totals are summed, and a window only runs inside a slice.

    Null keys share one digest and are ordered by size and text; equal rows are interchangeable.  Empty tables
    give empty results.  Columns of ``docs`` named size, source_size, target or taken are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")])
    digest, slices, slot, before, within, src, tie, epochs, own_slot, words = fresh(
        docs, "digest", "slices", "slot", "before", "within", "src", "tie", "epochs", "own_slot", "words")
    sized = (docs.withColumn("size", F.regexp_count(whole_text(text), F.lit(WORD)).cast("long"))
             .withColumn(tie, F.xxhash64(text)))
    totals = source_sizes(sized, source)
    if weights is None:
        # One row per source is all this window sees.
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        totals = totals.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    else:
        totals = totals.join(
            weights.select(F.col("source").alias(src), F.col("weight")), F.col("source").eqNullSafe(F.col(src)), "left"
        ).drop(src)
    targets = fill_targets(totals, max_epochs).select(
        F.col("source").alias(src), "source_size", "target", F.col("epochs").alias(epochs),
        F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / SLICE_ROWS)))).cast("long").alias(slices))

    # 28 bits of the digest number the slice; 2^28 slices of 4096 documents are enough for any source.
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    joined = (
        sized.withColumn(digest, order)
        .join(targets, F.col(source).eqNullSafe(F.col(src)), "left").drop(src)
        .withColumn(slot, F.floor(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")
                                  * F.col(slices) / F.lit(1 << 28)).cast("long")))
    # Only slice totals meet per source, at most one per 2 048 documents or so.
    slot_totals = joined.groupBy(F.col(source).alias(src), F.col(slot).alias(own_slot)).agg(F.sum("size").alias(words))
    lead = Window.partitionBy(src).orderBy(own_slot).rowsBetween(Window.unboundedPreceding, -1)
    slot_starts = slot_totals.select(src, own_slot, F.coalesce(F.sum(words).over(lead), F.lit(0)).alias(before))
    inside = (Window.partitionBy(source, slot)
              .orderBy(digest, "size", tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = F.floor(epochs)
    start = F.col(before) + F.coalesce(F.col(within), F.lit(0))
    rest = F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return (
        joined.withColumn(within, F.sum("size").over(inside))
        .join(slot_starts, F.col(source).eqNullSafe(F.col(src)) & (F.col(slot) == F.col(own_slot)), "left")
        .withColumn("taken", (whole * F.col("size") + part).cast("long"))
        .select(*docs.columns, "size", "source_size", "target", "taken"))
