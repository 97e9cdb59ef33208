"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.tables import WORD, fresh, whole_text

#: Share of all hash values that a fingerprint retains.
FRACTION = 0.125
SHINGLE_WORDS = 5
LEAST = -(1 << 63)


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION) -> DataFrame:
    """Adds ``name``: the sorted distinct 64-bit hashes of word 5-grams of the whole text that lie in the lowest
    ``fraction`` of all values.

    Equal texts have equal sketches, and the union of two sketches is the sketch of both texts together.  A text
    of under five words has one shingle, the empty or null text none.  Where no hash lies below the bound (short
    texts), the smallest is retained alone, so that only texts without words have an empty sketch.
    """
    words, hashes = fresh(df, f"{name}_words", f"{name}_hashes")
    bound = LEAST + int(fraction * (1 << 64))
    w = F.col(words)
    shingles = F.when(
        F.size(w) >= SHINGLE_WORDS,
        F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE_WORDS),
                    lambda i: F.xxhash64(*[w[i + j] for j in range(SHINGLE_WORDS)]))
    ).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    low = F.filter(F.col(hashes), lambda h: h < F.lit(bound))
    return (
        df.withColumn(words, F.regexp_extract_all(whole_text(text), F.lit(WORD), F.lit(0)))
        .withColumn(hashes, shingles).drop(words)
        .withColumn(name, F.array_sort(F.array_distinct(
            F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(low))))
        .drop(hashes))


def as_text(sketch: str | Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def jaccard(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two texts from their sketches, 0 to 1; two empty sketches are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.col(a)) + F.size(F.col(b)) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def containment(part: str, whole: str) -> Column:
    """Estimated share of ``part``'s shingles that ``whole`` has too; holds between very unequal documents."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(part, whole)) / F.size(part))


def merged(sketches: str | Column, fraction: float = FRACTION) -> Column:
    """Sketch of the union of the texts of an array of sketches."""
    union = F.array_sort(F.array_distinct(F.flatten(sketches)))
    low = F.filter(union, lambda h: h < F.lit(LEAST + int(fraction * (1 << 64))))
    return F.when((F.size(low) == 0) & (F.size(union) > 0), F.array(F.array_min(union))).otherwise(low)


def with_next_text(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text",
                   chunk_rows: int = 1024, most_chunks: int = 10_000) -> DataFrame:
    """Adds the text of the next document by descending numeric key; the last is followed by the first.

    Null keys come last, equal keys by a digest of the text.  Order needs no single task: quantiles of the key cut
    the table into chunks, a window runs in each, and the first row of a chunk is copied to the end of the chunk
    before it.  ``most_chunks`` bounds the list of cuts; beyond it chunks hold more rows, and their sort spills.
    """
    chunk, tie, ghost, first, own, nth = fresh(docs, "chunk", "tie", "ghost", "first_key", "own_chunk", "nth")
    count = docs.count()
    chunks = max(1, min(most_chunks, count // chunk_rows))
    cuts: list = []
    if chunks > 1:
        found, most = docs.agg(
            F.percentile_approx(key, [i / chunks for i in range(1, chunks)], max(10_000, 4 * chunks)), F.max(key)).first()
        cuts = sorted({c for c in found or [] if c < most})
    # Binary search in the list of cuts: the number of cuts below the key.
    steps = max(1, len(cuts).bit_length())
    padded = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    place = F.lit(0)
    if padded is not None:
        place = F.aggregate(
            F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)]), F.lit(0),
            lambda low, step: F.when((low + step <= len(cuts)) & (F.try_element_at(padded, low + step) < F.col(key)),
                                     low + step).otherwise(low))
    rows = docs.withColumn(chunk, F.coalesce(place, F.lit(0))).withColumn(tie, F.xxhash64(text)).withColumn(ghost, F.lit(0))
    # The first row of each chunk: one key per chunk, then its row by the key.
    heads = rows.groupBy(F.col(chunk).alias(own)).agg(F.max(key).alias(first))
    rank = F.row_number().over(Window.partitionBy(chunk).orderBy(tie))
    firsts = (
        rows.join(F.broadcast(heads), (F.col(chunk) == F.col(own)) & F.col(key).eqNullSafe(F.col(first)), "inner")
        .drop(own, first).withColumn(nth, rank).filter(F.col(nth) == 1).drop(nth)
        .withColumn(chunk, F.when(F.col(chunk) == len(cuts), 0).otherwise(F.col(chunk) + 1))
        .withColumn(ghost, F.lit(1)))
    order = Window.partitionBy(chunk).orderBy(ghost, F.col(key).desc_nulls_last(), tie)
    return (
        rows.unionByName(firsts).withColumn(name, F.lead(whole_text(text)).over(order))
        .filter(F.col(ghost) == 0).drop(chunk, tie, ghost))


def edited_text(text: str, following: str) -> Column:
    """The text whose last floor(n/2) code points are replaced by the first as many (or all) of another."""
    t = whole_text(text)
    half = F.floor(F.char_length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.char_length(t) - half), F.substring(whole_text(following), F.lit(1), half))
