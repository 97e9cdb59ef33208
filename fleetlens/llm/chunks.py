"""Remove passages that repeat across documents, found as runs of content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.arrays import IS_BLANK, U64, Spans, mixed, seeded, signed, text_buffers, word_spans
from fleetlens.llm.tables import fresh, whole_text

#: One random 16-bit value per byte; the rolling hash of a position covers the 16 bytes up to it.
GEAR = (seeded(256, 71) >> U64(48)).astype(np.uint16)
#: A blank ends a chunk when its hash is below this: one blank in four.
BOUND = 1 << 14
LONGEST = 4096
#: Inside a chunk longer than this any character may end a chunk: where the hash falls below the second bound, one in 32.
UNSPACED = 256
INNER_BOUND = 1 << 11
#: Digests of longer chunks come from a hash without algebraic structure, which chosen texts can't make equal.
PLAIN = 256
#: A word of more bytes than this is a stretch of text without blanks, and counts a word for every so many bytes.
LONG_WORD, WORD_BYTES = 48, 6


def gear_hashes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] at every byte, begun anew at each row, by doubling."""
    h = GEAR[buf]
    place = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in (1, 2, 4, 8):
        if len(buf) > step:
            h[step:] = h[step:] + np.where(place[step:] >= step, h[:-step] << np.uint16(step), np.uint16(0))
    return h


def chunk_ends(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """End of every chunk.

    Rows end chunks, and blanks by their hash.  Within chunks that stay long, as where text has no blanks, characters do by
    theirs, but not two in a row; what is still long, one character over and over, ends at each 4 096th byte.
    """
    gear = gear_hashes(buf, offsets)
    cut = IS_BLANK[buf] & (gear < BOUND)
    ends = np.union1d(np.flatnonzero(cut) + 1, offsets[1:][np.diff(offsets) > 0])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    long = ends - starts > UNSPACED
    if long.any():
        # Where a character ends: the next byte begins one.  A position that follows another cut is none.
        inner = np.zeros(len(buf), bool)
        low = gear < INNER_BOUND
        inner[:-1] = low[:-1] & ((buf[1:] & 0xC0) != 0x80)
        before = np.r_[False, low[:-1]]
        before[offsets[:-1][offsets[:-1] < len(buf)]] = False
        inner &= ~before
        marks = np.zeros(len(buf) + 1, np.int8)
        np.add.at(marks, starts[long], 1)
        np.add.at(marks, ends[long], -1)
        inner &= np.cumsum(marks[:-1]) > 0
        ends = np.union1d(ends, np.flatnonzero(inner) + 1)
        starts = np.r_[0, ends[:-1]]
    more = []
    for a, b in zip(starts[ends - starts > LONGEST], ends[ends - starts > LONGEST]):
        at = np.arange(a + LONGEST, b, LONGEST)
        for _ in range(3):
            at = at + ((buf[np.minimum(at, b - 1)] & 0xC0) == 0x80)
        more.append(at[at < b])
    return np.union1d(ends, np.concatenate(more)) if more else ends


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every chunk."""
    out = Spans(buf)(starts, ends)
    long = np.flatnonzero(ends - starts > PLAIN)
    if len(long):
        data = buf.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def word_counter(buf: np.ndarray, offsets: np.ndarray):
    """A function of runs of bytes: their words, of which stretches without blanks have one for every few bytes."""
    start, end, _ = word_spans(buf, offsets)
    long = end - start > LONG_WORD
    marks = np.zeros(len(buf) + 1, np.int64)
    np.add.at(marks, start[long], 1)
    np.add.at(marks, end[long], -1)
    stretch = np.r_[0, np.cumsum(np.cumsum(marks[:-1]))]
    plain = start[~long]
    return lambda heads, tails: (np.searchsorted(plain, tails) - np.searchsorted(plain, heads)
                                 + (stretch[tails] - stretch[heads]) // WORD_BYTES)


def chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, rank, text) to (digest, row, rank, idx, again): each chunk of each text.

    ``again`` marks a chunk that a text of the batch with a smaller rank, or the same text before, has too; it needs
    no comparison elsewhere, so its digest is replaced by one of its own and the copies of a frequent chunk spread.
    """
    for batch in batches:
        row, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = []
        for low, high, buf, offsets in text_buffers(batch.column(2)):
            ends = chunk_ends(buf, offsets)
            if not len(ends):
                continue
            digest = digests(buf, np.r_[0, ends[:-1]], ends)
            owner = np.searchsorted(offsets, ends, "left") - 1
            # Rows without bytes share an offset with the row before them, which the search passes over.
            idx = np.arange(len(ends)) - np.searchsorted(owner, owner)
            parts.append((digest, owner + low, idx))
        if not parts:
            continue
        digest, owner, idx = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((idx, row[owner], rank[owner], digest))
        again = np.zeros(len(digest), bool)
        again[order[1:]] = digest[order[1:]] == digest[order[:-1]]
        own = mixed(row[owner].astype(U64) * U64(1 << 20) + idx.astype(U64))
        yield pa.record_batch(
            [signed(np.where(again, own, digest)), pa.array(row[owner]), pa.array(rank[owner]),
             pa.array(idx.astype(np.int32)), pa.array(again)], ["digest", "row", "rank", "idx", "again"])


def cut_runs(least_words: int):
    """A mapper of (row, idxs, text) to (row, kept, n_removed, n_spans): texts without the runs of listed chunks that
    have ``least_words`` words or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            kept, removed, spans = [], [], []
            for low, high, buf, offsets in text_buffers(batch.column(2)):
                ends = chunk_ends(buf, offsets)
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                first = np.searchsorted(starts, offsets)
                count = word_counter(buf, offsets)
                for r in range(high - low):
                    marked = lists[low + r].as_py()
                    a, b = offsets[r], offsets[r + 1]
                    text = buf[a:b].tobytes()
                    n = s = 0
                    if marked and first[r + 1] > first[r]:
                        at = np.unique(np.array(marked)) + first[r]
                        breaks = np.flatnonzero(np.diff(at) > 1)
                        heads, tails = starts[at[np.r_[0, breaks + 1]]], ends[at[np.r_[breaks, len(at) - 1]]]
                        words = count(heads, tails)
                        keep, from_ = [], a
                        for h, t in zip(heads[words >= least_words], tails[words >= least_words]):
                            keep.append(buf[from_:h].tobytes())
                            from_, n, s = t, n + int(t - h), s + 1
                        text = b"".join([*keep, buf[from_:b].tobytes()])
                    kept.append(text.decode("utf-8", "replace"))
                    removed.append(n)
                    spans.append(s)
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.string()), pa.array(removed, pa.int64()),
                                   pa.array(spans, pa.int64())], ["row", "kept", "n_removed", "n_spans"])
    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 24) -> DataFrame:
    """All columns of ``docs`` with the text without its repeated passages, and n_removed and n_spans.

    Texts are cut into chunks of about four words at blanks chosen by a gear rolling hash, and text without blanks at characters
    chosen by it, so an insertion moves no cut beyond its neighbourhood.  Of equal chunks the one of the smallest key (then in table order) is the first; the
    others repeat it.  A run of consecutive repeating chunks goes if it has ``least_words`` words or more.  Since the
    chunks at both ends of a shared passage are seldom whole, 24 words in whole chunks stand for a passage of about 50.

    A word of more than 48 bytes counts one for every six.  Null is the empty text, which stays empty.  Null keys come last;
    keys that are no whole numbers are not compared, the table's order decides.  Repeated rows repeat each other.  Rows are told
    apart by their place, so ``docs`` should be a stored table.  n_removed counts bytes, n_spans runs; columns of these
    names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_removed", "n_spans")])
    row, = fresh(docs, "row_id")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    last = F.lit((1 << 63) - 1)
    rank = F.coalesce(F.col(key).cast("bigint"), last) if whole else F.when(F.col(key).isNull(), last).otherwise(0)
    chunks = placed.select(F.col(row).alias("row"), rank.alias("rank"), whole_text(text).alias("text")).mapInArrow(
        chunk_digests, "digest bigint, row bigint, rank bigint, idx int, again boolean")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("again", "rank", "row", "idx"))
    repeats = (chunks.withColumn("place", place).filter("again or place > 1")
               .groupBy("row").agg(F.collect_list("idx").alias("idxs")))
    mark, idxs = fresh(docs.withColumn(row, F.lit(0)), "mark", "idxs")
    cut = placed.join(repeats.select(F.col("row").alias(mark), F.col("idxs").alias(idxs)), F.col(row) == F.col(mark), "left")
    others = [c for c in docs.columns if c != text]
    runs = cut_runs(least_words)

    def with_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            narrow = pa.record_batch([batch.column(n - 3), batch.column(n - 2), batch.column(n - 1)], ["row", "idxs", "text"])
            for out in runs(iter([narrow])):
                yield pa.record_batch([*batch.columns[: n - 3], *out.columns[1:]], [f"c{i}" for i in range(n)])

    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(others)]
    plain = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*named).schema.fields]
    n = len(others)
    out = cut.select(*named, F.col(row).alias("row"), F.col(idxs).alias("idxs"), whole_text(text).alias("text")).mapInArrow(
        with_others, ", ".join([*plain, f"c{n} string, c{n + 1} bigint, c{n + 2} bigint"]))
    place = {c: f"c{i}" for i, c in enumerate(others)} | {text: f"c{n}"}
    return out.select(*[F.col(place[c]).alias(c) for c in docs.columns],
                      F.col(f"c{n + 1}").alias("n_removed"), F.col(f"c{n + 2}").alias("n_spans"))
