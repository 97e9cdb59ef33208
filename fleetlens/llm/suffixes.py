"""Remove byte strings that occur more than once, by induced sorting of sampled suffixes on Spark's external sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import U64, Spans, mixed, seeded, signed, text_buffers
from fleetlens.llm.tables import whole_text
from fleetlens.session import cut_lineage

#: A suffix is sampled if its 16 bytes hash lowest among 128 neighbouring starts, so about one in 64 is.
GRAM, NEIGHBOURS = 16, 128
GRAM_FACTORS = seeded(2, 91) | U64(1)


def lowest_starts(buf: np.ndarray) -> np.ndarray:
    """For each p, the leftmost start with the lowest hash of 16 bytes among p .. p + 127."""
    n = len(buf) - GRAM + 1
    if n < NEIGHBOURS:
        return np.zeros(0, np.int32)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(buf), 8), (1, 1))
    eight = np.ascontiguousarray(eight).view(U64).ravel()
    low = (mixed(eight[:n] * GRAM_FACTORS[0] + eight[8: 8 + n] * GRAM_FACTORS[1]) >> U64(32)).astype(np.uint32)
    at = np.arange(n, dtype=np.int32)
    step = 1
    while step < NEIGHBOURS:
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        step *= 2
    return at


def sampled(buf: np.ndarray, offsets: np.ndarray, length: int):
    """(owner, lo, hi, at): runs lo .. hi of starts of ``length``-byte strings of one row that share the sampled
    suffix ``at``; every such string holds the first length - 127 bytes of its suffix."""
    lowest = lowest_starts(buf)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    counts = sizes[rows] - length + 1
    owner = np.repeat(rows, counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[rows], counts)
    at = lowest[starts].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    hi = starts[np.r_[new[1:] - 1, len(starts) - 1]]
    return owner[new], starts[new], hi, at[new]


#: Marks of a tuple: all strings of the suffix repeat; its strings must be told apart one by one; it stands aside of the
#: sort, because its batch holds another tuple of its name.
WHOLE, BORDER, ASIDE = 1, 2, 4
TUPLES = "name bigint, row bigint, at bigint, next_name bigint, mark byte"


def folded(name: np.ndarray, row: np.ndarray, at: np.ndarray, next_name: np.ndarray, mark: np.ndarray, found: int) -> pa.RecordBatch:
    """Tuples of a batch, before they are sorted by name.

    Where the batch itself has a name twice, its tuples get the mark ``found``.  One of them keeps the name, for tuples
    of other batches; the rest stand aside under names of their own, so that the sort sees a frequent name once per batch.
    """
    mark = mark.astype(np.int8)
    order = np.argsort(name, kind="stable")
    order = order[(mark[order] & ASIDE) == 0]
    same = name[order[1:]] == name[order[:-1]]
    mark[order[1:]] |= np.where(same, found | ASIDE, 0).astype(np.int8)
    mark[order[:-1]] |= np.where(same, found, 0).astype(np.int8)
    own = mixed(row.astype(U64) * U64(0x9E3779B97F4A7C15) + at.astype(U64))
    return pa.record_batch([signed(np.where(mark & ASIDE, own, name)), pa.array(row), pa.array(at.astype(np.int64)),
                            signed(next_name), pa.array(mark)], ["name", "row", "at", "next_name", "mark"])


def suffix_names(length: int):
    """A mapper of (row, text) to suffix tuples: ``name`` stands for everything that the strings of a sampled suffix
    cover, ``next_name`` for the bytes that all of them share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for low, _, buf, offsets in text_buffers(batch.column(1)):
                owner, lo, hi, at = sampled(buf, offsets, length)
                if len(at):
                    spans = Spans(buf)
                    parts.append((spans(lo, hi + length), ids[owner + low], at - offsets[owner],
                                  spans(at, at + length - NEIGHBOURS + 1), np.zeros(len(at), np.int8)))
            if parts:
                yield folded(*(np.concatenate(x) for x in zip(*parts)), WHOLE)
    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(tuples, left, right) of tuples sorted by name: whether the left and the right neighbour has the same name, across
    batches."""
    kept, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if kept is None else pa.concat_batches([kept, batch])
        names = table.column(0).to_numpy()
        same = names[1:] == names[:-1]
        # The last tuple waits for its right neighbour.
        if len(same):
            yield table.slice(0, len(same)), np.r_[before is not None and before == names[0], same[:-1]], same
            before = names[-2]
        kept = table.slice(table.num_rows - 1)
    if kept is not None:
        yield kept, np.array([before is not None and before == kept.column(0)[0].as_py()]), np.array([False])


def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tuples sorted by their first name, marked and renamed for the second sort.

    Of equal names only the first goes on; so the second sort sees each different content once, and a name that
    repeats there is shared by different contents.
    """
    for table, left, right in neighbours(batches):
        mark = table.column("mark").to_numpy().copy()
        mark[left | right] |= WHOLE
        mark[left] |= ASIDE
        name = table.column("next_name").to_numpy().view(U64)
        yield folded(name, table.column("row").to_numpy(), table.column("at").to_numpy(), name, mark, BORDER)


def marked(found: int):
    """A mapper of tuples sorted by name to (row, at, mark) of those with a mark, with ``found`` where a neighbour has the
    same name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, left, right in neighbours(batches):
            mark = table.column("mark").to_numpy().copy()
            mark[left | right] |= found
            mark &= WHOLE | BORDER
            yield pa.record_batch([table.column("row"), table.column("at"), pa.array(mark)], ["row", "at", "mark"]).filter(pa.array(mark > 0))
    return run


def by_name(tuples: DataFrame) -> DataFrame:
    """One external sort by name."""
    return tuples.repartition("name").sortWithinPartitions("name")


def flags_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled suffixes of a row whose strings all repeat, and those whose strings are told apart."""
    both = np.array(column[k].as_py() or [], np.int64)
    return both[(both & WHOLE) > 0] >> 2, both[(both & BORDER) > 0] >> 2


def border_names(length: int):
    """A mapper of (row, flags, text) to tuples of single strings, induced leftwards from the sampled suffixes at the
    borders of matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for low, _, buf, offsets in text_buffers(batch.column(2)):
                owner, lo, hi, at = sampled(buf, offsets, length)
                if not len(at):
                    continue
                border = np.zeros(len(at), bool)
                for r in np.unique(owner):
                    own = slice(*np.searchsorted(owner, (r, r + 1)))
                    border[own] = np.isin(at[own] - offsets[r], flags_of(batch.column(1), low + r)[1])
                counts = (hi - lo + 1)[border]
                if not len(counts):
                    continue
                starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[border], counts)
                rows = np.repeat(owner[border], counts)
                name = Spans(buf)(starts, starts + length)
                parts.append((name, ids[rows + low], starts - offsets[rows], name, np.zeros(len(name), np.int8)))
            if parts:
                yield folded(*(np.concatenate(x) for x in zip(*parts)), WHOLE)
    return run


def cut_covered(length: int):
    """A mapper of (row, flags, starts, text) to (row, n_removed, n_spans, kept): texts without repeated bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for low, high, buf, offsets in text_buffers(batch.column(3)):
                owner, lo, hi, at = sampled(buf, offsets, length)
                change = np.zeros(len(buf) + 1, np.int64)
                for r in range(high - low):
                    a, b = offsets[r], offsets[r + 1]
                    whole, _ = flags_of(batch.column(1), low + r)
                    single = np.array(batch.column(2)[low + r].as_py() or [], np.int64) + a
                    own = slice(*np.searchsorted(owner, (r, r + 1)))
                    hit = np.isin(at[own] - a, whole)
                    np.add.at(change, np.r_[lo[own][hit], single], 1)
                    np.add.at(change, np.r_[hi[own][hit], single] + length, -1)
                    gone = np.cumsum(change[a:b]) > 0
                    # Strings never cross rows, so the sum is zero again at the row's end.
                    change[b] = 0
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()))
                    kept.append(buf[a:b][~gone].tobytes())
            yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                   pa.array(kept, pa.binary())], ["row", "n_removed", "n_spans", "kept"])
    return run


def remove_repeated_bytes(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """(row, n_removed, n_spans, kept): for each row of ``docs`` its text's bytes without those that a string of
    ``length`` bytes covers which also starts anywhere else, in the same text or another.

    ``row`` is monotonically_increasing_id() of ``docs``, which should be a stored table.  ``kept`` is binary, since a cut
    may part a character.  Null is the empty text; matches never cross rows; repeated rows are repeats of each other.

    Suffixes are sampled by content: of 128 neighbouring starts the one whose 16 bytes hash lowest, so that equal strings
    hold equal samples.  A first sort names everything that the strings of a sample cover; where that repeats, so does
    every string.  A second sort takes each different content once and names the bytes that all its strings share; where
    those repeat, a match may end between the contents, so their strings are induced leftwards from the sample
    and sorted in a third.  A name is 64 bits of the bytes' hash.  The queue is Spark's external sort, whose runs lie
    on the executors' disks; common prefixes travel as names, equal or not, which is all that a bound of ``length`` asks for.
    """
    if length < NEIGHBOURS + GRAM:
        raise ValueError(f"length must be at least {NEIGHBOURS + GRAM}")
    placed = docs.select(F.monotonically_increasing_id().alias("row"), whole_text(text).alias("text"))
    first = by_name(placed.mapInArrow(suffix_names(length), TUPLES)).mapInArrow(next_level, TUPLES)
    flags = cut_lineage(
        by_name(first.drop("next_name")).mapInArrow(marked(BORDER), "row bigint, at bigint, mark byte")
        .groupBy("row").agg(F.collect_list(F.col("at") * 4 + F.col("mark")).alias("flags")))
    flagged = placed.join(flags, "row").select("row", "flags", "text")
    starts = (by_name(flagged.mapInArrow(border_names(length), TUPLES).drop("next_name"))
              .mapInArrow(marked(WHOLE), "row bigint, at bigint, mark byte")
              .groupBy("row").agg(F.collect_list("at").alias("starts")))
    cut = (flagged.join(starts, "row", "left").select("row", "flags", "starts", "text")
           .mapInArrow(cut_covered(length), "row bigint, n_removed bigint, n_spans bigint, kept binary"))
    return cut.filter("n_removed > 0")


def digest_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``; see :func:`remove_repeated_bytes`.

    Rows that lose nothing are digested where they are read.
    """
    cut = remove_repeated_bytes(docs, text, length).select(
        F.col("row").alias("cut_row"), "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    every = docs.select(
        F.col(key), F.monotonically_increasing_id().alias("row"), F.octet_length(whole_text(text)).cast("long").alias("n_bytes"),
        F.sha2(whole_text(text), 256).alias("own_sha256"))
    return every.join(cut, F.col("row") == F.col("cut_row"), "left").select(
        key, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("cut_sha256", "own_sha256").alias("kept_sha256"))
