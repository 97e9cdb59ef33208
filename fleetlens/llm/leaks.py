"""Find benchmark passages in documents by latent semantic retrieval, then by common subsequences and answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import BASE, BASE_INVERSE, IS_MARK, U64, Spans, mixed, powers, text_buffers, word_spans
from fleetlens.llm.tables import fresh, whole_text
from fleetlens.session import cut_lineage

#: Words are hashed into so many terms, and the terms of the items into at most so many columns: every matrix that a
#: task or the driver holds has a fixed size.
TERMS, COLUMNS = 1 << 17, 1 << 15
RANK = 128
#: Words of a block; a search window is a run of blocks.
STEP = 8
PASSAGE = 32
#: Passages whose terms are counted end where two neighbouring words say so, one place in 16, or after so many words.
LONGEST = 64
#: A window must have this share of an item's weight, whatever its cosine.
LEAST_SHARE = 0.25
#: Items searched at once.
ITEMS = 512
#: Rows added up one by one, and runs of them side by side: so much fits a core's cache.
RUN, SIDE = 32, 1024


def word_ids(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word ids, first word of each row) of pieces of a column, in lower case and without ASCII marks."""
    for low, _, buf, offsets in text_buffers(texts, lower=True):
        start, end, first = word_spans(buf, offsets, IS_MARK)
        yield low, (Spans(buf)(start, end) >> U64(32)).astype(np.uint32), first


def as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, words): the 32-bit ids of the words of a text, packed."""
    for batch in batches:
        out = []
        for _, ids, first in word_ids(batch.column(1)):
            out += [ids[a:b].tobytes() for a, b in zip(first, first[1:])]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["row", "words"])


def packed_words(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word ids, first word of each row) of consecutive rows of packed words, some at a time."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 4 * limit, "right")) - 1)
        yield row, data[offsets[row]: offsets[last]].view(np.uint32), (offsets[row: last + 1] - offsets[row]) // 4
        row = last


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(15)).astype(np.int32)


def passage_of_word(first: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Number of the fixed-width passage of each word (passages end with their row), and how many there are."""
    counts = np.diff(first)
    passages = -(-counts // width)
    begin = np.cumsum(passages) - passages
    place = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(begin, counts) + place // width, int(passages.sum())


def cut_passages(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, digest) of the passages of some rows: where they end depends on their words, not on their place."""
    n = len(words)
    place = np.arange(n)
    pair = words * np.uint32(0x9E3779B1)
    pair[1:] += words[:-1] * np.uint32(0x85EBCA6B)
    cut = pair >> np.uint32(28) == 0
    cut[first[:-1][first[:-1] < n]] = True
    since = place - np.maximum.accumulate(np.where(cut, place, 0))
    begin = np.flatnonzero(cut | (since % LONGEST == 0))
    value = mixed(words.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1)) * powers(BASE, n)[:n]
    length = np.diff(np.r_[begin, n]).astype(U64)
    return begin, mixed(np.add.reduceat(value, begin) * powers(BASE_INVERSE, n)[begin] + length)


class Seen:
    """The digests that a task has met, sorted."""

    def __init__(self):
        self.digests = np.zeros(0, U64)

    def new(self, digests: np.ndarray) -> np.ndarray:
        """Places of the first of each digest not met before, which is met now."""
        found, at = np.unique(digests, return_index=True)
        to = np.searchsorted(self.digests, found)
        known = np.zeros(len(found), bool)
        inside = to < len(self.digests)
        known[inside] = self.digests[to[inside]] == found[inside]
        self.digests = np.insert(self.digests, to[~known], found[~known])
        return at[~known]


def distinct_passages(buckets: int):
    """A mapper of packed words to (bucket, digests, lengths, terms): each passage once per task, packed by its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for _, words, first in packed_words(batch.column(0)):
                if not len(words):
                    continue
                begin, digest = cut_passages(words, first)
                length = np.diff(np.r_[begin, len(words)]).astype(np.int32)
                new = seen.new(digest)
                if not len(new):
                    continue
                bucket = (digest[new] % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                new, bucket = new[order], bucket[order]
                ends = np.cumsum(length[new])
                at = np.repeat(begin[new] - (ends - length[new]), length[new]) + np.arange(ends[-1])
                terms = terms_of(words)[at]
                heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                spans = list(zip(heads, np.r_[heads[1:], len(new)]))
                from_word = np.r_[0, ends]
                yield pa.record_batch([
                    pa.array(bucket[heads], pa.int32()),
                    pa.array([digest[new[a:b]].tobytes() for a, b in spans], pa.binary()),
                    pa.array([length[new[a:b]].tobytes() for a, b in spans], pa.binary()),
                    pa.array([terms[from_word[a]: from_word[b]].tobytes() for a, b in spans], pa.binary()),
                ], ["bucket", "digests", "lengths", "terms"])
    return run


def passage_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: in how many distinct passages each term occurs, and how many of them there are."""
    total, count, seen = np.zeros(TERMS, np.int64), 0, Seen()
    for batch in batches:
        digests, lengths, terms = (np.frombuffer(b"".join(batch.column(k).to_pylist()), t)
                                   for k, t in ((1, U64), (2, np.int32), (3, np.int32)))
        first = np.zeros(len(digests), bool)
        first[seen.new(digests)] = True
        passage = np.repeat(np.arange(len(digests)), lengths)
        own = first[passage]
        cells = np.sort(passage[own] * TERMS + terms[own])
        if len(cells):
            cells = cells[np.r_[True, cells[1:] != cells[:-1]]]
            total += np.bincount(cells % TERMS, minlength=TERMS)
        count += int(first.sum())
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([count], pa.int64())], ["frequencies", "passages"])


def row_sums(matrix: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of a matrix over consecutive runs of ``counts`` places, none of them empty.

    Many runs are added up side by side, a row of each at a time; longer ones than ``RUN`` are cut, and their parts added.
    """
    if not len(counts):
        return np.zeros((0, matrix.shape[1]), matrix.dtype)
    if counts.max() > RUN:
        parts = -(-counts // RUN)
        last = np.cumsum(parts) - 1
        lengths = np.full(last[-1] + 1, RUN)
        lengths[last] = counts - (parts - 1) * RUN
        return row_sums(row_sums(matrix, at, lengths), np.arange(len(lengths)), parts)
    order = np.argsort(-counts, kind="stable")
    heads, falling = (np.cumsum(counts) - counts)[order], -counts[order]
    out = np.empty((len(counts), matrix.shape[1]), matrix.dtype)
    for low in range(0, len(counts), SIDE):
        head, left = heads[low: low + SIDE], falling[low: low + SIDE]
        sums = matrix[at[head]]
        for j in range(1, -left[0]):
            live = np.searchsorted(left, -j)
            sums[:live] += matrix[at[head[:live] + j]]
        out[order[low: low + SIDE]] = sums
    return out


def range_step(column: np.ndarray, basis: np.ndarray):
    """A mapper to one row per task of A'A·basis over its passages.

    A has a row per passage and a column per item term; ``column`` gives a term's column, -1 for others, and ``basis``
    holds the weights already.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for _, words, first in packed_words(batch.column(0)):
                if not len(words):
                    continue
                passage, _ = passage_of_word(first, PASSAGE)
                at = column[terms_of(words)]
                known = at >= 0
                at, passage = at[known], passage[known]
                if not len(at):
                    continue
                fresh_passage = np.r_[True, passage[1:] != passage[:-1]]
                y = row_sums(basis, at, np.diff(np.r_[np.flatnonzero(fresh_passage), len(at)]))
                order = np.argsort(at.astype(np.int16), kind="stable")
                sorted_at = at[order]
                heads = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
                total[sorted_at[heads]] += row_sums(y, (np.cumsum(fresh_passage) - 1)[order], np.diff(np.r_[heads, len(at)]))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])
    return run


def summed(parts: DataFrame, dtype: type, column: str) -> np.ndarray | None:
    """Element sum of the packed arrays of all rows, or none without rows.

    Rows are added up in a sixteenth as many tasks as the cluster has cores, then in eight, then in the driver: what reaches
    it depends on neither tasks nor data.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                x = np.frombuffer(value.as_buffer(), dtype)
                total = x.copy() if total is None else np.add(total, x, out=total)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], [column])

    rows = parts.select(column)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    for folds in (cores // 16, 8):
        if folds >= 8:
            rows = rows.repartition(folds).mapInArrow(fold, f"{column} binary")
    found = [np.frombuffer(r[0], dtype) for r in rows.collect()]
    return np.sum(found, axis=0, dtype=np.int64 if dtype == np.int64 else np.float64) if found else None


class Latent:
    """Weights of all terms, and the projection of the items' terms onto the latent space."""

    def __init__(self, weights: np.ndarray, column: np.ndarray, vectors: np.ndarray):
        self.energy = (weights ** 2).astype(np.float32)
        self.column = column
        own = np.zeros(len(vectors), np.float32)
        own[column[column >= 0]] = weights[column >= 0]
        self.projection = (own[:, None] * vectors).astype(np.float32)


def fit_latent(words: DataFrame, item_words: DataFrame, rank: int = RANK, seed: int = 3) -> Latent:
    """The latent space of two packed word tables, documents and items.

    Terms are weighted by their inverse frequency over the distinct passages of all documents: what is copied, at any
    place of a text, counts once, and no term is without weight.  Passages here end by their content; those of the matrix
    have 32 words.  The TF-IDF matrix
    has a row per passage and a column per term of the items, whose own rows are weighted up until they count as much as
    all passages.  Its right singular vectors come from a randomised SVD: one pass over both tables samples the range of
    A'A with a Gaussian matrix, a second restricts A'A to it, both as sums over tasks of matrices of fixed size; the
    driver orthogonalises and decomposes them.
    """
    # More buckets than tasks, so that these are of like size.
    buckets = 8 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counts(table):
        dealt = table.select("words").mapInArrow(
            distinct_passages(buckets), "bucket int, digests binary, lengths binary, terms binary").repartition("bucket")
        rows = cut_lineage(dealt.mapInArrow(passage_frequencies, "frequencies binary, passages bigint"))
        found = summed(rows, np.int64, "frequencies")
        return np.zeros(TERMS, np.int64) if found is None else found, rows.agg(F.sum("passages")).first()[0] or 0

    frequencies, passages = counts(words)
    of_items, n_items = counts(item_words)
    weights = np.log(1 + (1 + passages) / (1 + frequencies)).astype(np.float32)
    kept = np.flatnonzero(of_items > 0)
    column = np.full(TERMS, -1, np.int32)
    column[kept] = np.arange(len(kept)) % COLUMNS
    size = min(len(kept), COLUMNS)
    rank = min(rank, size)
    own = np.zeros(size, np.float32)
    own[column[kept]] = weights[kept]
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, rank)))[0].astype(np.float32)
    vectors = basis
    for last in (False, True):
        image = np.zeros((size, rank))
        for table, times in ((words, 1.0), (item_words, passages / max(1, n_items))):
            part = summed(table.select("words").mapInArrow(range_step(column, own[:, None] * basis), "part binary"),
                          np.float32, "part")
            if part is not None and size:
                image += times * own[:, None] * part.reshape(size, rank)
        if last and size:
            values, turn = np.linalg.eigh(basis.T @ image)
            vectors = basis @ turn[:, ::-1]
        elif size:
            basis = np.linalg.qr(image)[0].astype(np.float32)
    return Latent(weights, column, vectors)


def subsequence_length(a: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Longest common subsequence of ``a`` with each of ``rows``, in words: one bit per word of ``a``, in Python's
    long integers."""
    masks: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    out = []
    for row in rows:
        v = full
        for w in row.tolist():
            m = masks.get(w)
            if m is not None:
                u = v & m
                v = ((v + u) | (v - u)) & full
        out.append(len(a) - v.bit_count())
    return np.array(out, np.int64)


def common_lengths(masks: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each window with its text, in words, as :func:`subsequence_length` has it of one.

    ``masks`` has, by window, word and group of 64 places, a bit for each place of the text where the word stands.
    """
    n, length, groups = masks.shape
    masks = np.ascontiguousarray(masks.transpose(1, 2, 0))
    v = np.full((groups, n), ~U64(0))
    for j in range(length):
        carry = np.zeros(n, bool)
        for g in range(groups):
            old = v[g]
            u = old & masks[j, g]
            total = old + u
            over = total < old
            if g:
                total += carry
                over |= carry & (total == 0)
            v[g] = total | (old ^ u)
            carry = over
    # A bit is cleared for each word shared; places beyond the text have no words, and keep theirs.
    return np.bitwise_count(~v).sum(axis=0, dtype=np.int64)


def split_words(texts: list) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, ids, first in word_ids(pa.array(texts, pa.large_string())):
        out += [ids[a:b] for a, b in zip(first, first[1:])]
    return out


class Items:
    """Benchmark items with their words, answers and latent vectors."""

    def __init__(self, ids: list, texts: list, answers: list, latent: Latent):
        self.ids, self.words, self.answers = ids, split_words(texts), split_words(answers)
        self.lengths = np.array([len(w) for w in self.words])
        # The window of an item has its length in whole blocks.
        self.blocks = -(-self.lengths // STEP)
        vectors = np.zeros((len(ids), latent.projection.shape[1]), np.float32)
        norms = np.zeros(len(ids), np.float32)
        for k, w in enumerate(self.words):
            at = latent.column[terms_of(w)]
            vectors[k] = latent.projection[at[at >= 0]].sum(axis=0)
            norms[k] = np.sqrt(latent.energy[np.unique(terms_of(w))].sum())
        inside = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
        # With these, a window's product over its own norm is 1 for the item itself, however much the space keeps of it.
        self.vectors = vectors * (norms / inside ** 2)[:, None]
        self.norms = norms
        #: All words of items and answers; a word's number is its place here, that of any other word is their count.
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint32), *self.words, *self.answers]))
        self.has_term = np.zeros(TERMS, bool)
        self.has_term[terms_of(self.vocabulary)] = True
        self.word_numbers, self.answer_numbers = ([self.numbers(w) for w in texts] for texts in (self.words, self.answers))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), len(self.vocabulary), np.int32)
        maybe = np.flatnonzero(self.has_term[terms_of(words)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == words[maybe]
            out[maybe[same]] = at[same]
        return out

    def masks(self, numbers: list[np.ndarray], item: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For each window, word and group of 64 places, the places in the text of the window's item where the word stands."""
        groups = max(1, -(-max(len(numbers[k]) for k in np.unique(item)) // 64))
        out = np.empty((*windows.shape, groups), U64)
        order = np.argsort(item, kind="stable")
        table = np.zeros((len(self.vocabulary) + 1, groups), U64)
        for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            text = numbers[item[own[0]]]
            place = np.arange(len(text))
            np.bitwise_or.at(table, (text, place >> 6), U64(1) << (place & 63).astype(U64))
            out[own] = table[windows[own]]
            table[text] = 0
        return out


def search(items: Items, latent: Latent, cosine: float, common: float, weaker: float):
    """A mapper of (row, words) to (row, item, cosine, shared, answer): contaminated rows and the item they hold."""
    groups = {int(b): np.flatnonzero((items.blocks == b) & (items.lengths > 0)) for b in np.unique(items.blocks) if b > 0}

    def verified(numbers, low, high, item):
        """(places, shared words, whether the answer is there) of the candidates that count: windows low:high and their items."""
        length = int((high - low).max())
        at = low[:, None] + np.arange(length)
        windows = np.where(at < high[:, None], numbers[np.minimum(at, len(numbers) - 1)], len(items.vocabulary))
        masks = items.masks(items.word_numbers, item, windows)
        # A common subsequence can't be longer than the words both have; many candidates end here.
        left = np.flatnonzero(masks.any(axis=2).sum(axis=1) >= weaker * items.lengths[item])
        shared = common_lengths(masks[left])
        enough = shared >= weaker * items.lengths[item[left]]
        left, shared = left[enough], shared[enough]
        if not len(left):
            return left, shared, np.zeros(0, bool)
        size = np.array([len(items.answers[k]) for k in item[left]])
        has_answer = (size > 0) & (common_lengths(items.masks(items.answer_numbers, item[left], windows[left])) == size)
        counts = has_answer | (shared >= common * items.lengths[item[left]])
        return left[counts], shared[counts], has_answer[counts]

    def piece(words, first) -> list[tuple]:
        """(row, item, cosine, shared words, answer) of each row and item that it holds, by the first of its best windows."""
        block, n = passage_of_word(first, STEP)
        begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        row_of = np.searchsorted(first, begin, "right") - 1
        last_block = np.searchsorted(row_of, row_of, "right")
        term = terms_of(words)
        at = latent.column[term]
        energy = latent.energy[term].astype(np.float64)
        whole = np.r_[0, np.cumsum(energy)]
        kept = np.r_[0, np.cumsum(np.where(at >= 0, energy, 0))]
        border = np.r_[begin, len(words)]
        # The cosine of a window and any item is at most the share of the window's norm that lies in item terms, so most
        # windows need no vector.
        tries = {}
        needed = np.zeros(n + 1, np.int32)
        for width, members in groups.items():
            to = np.minimum(np.arange(n) + width, last_block)
            norm = np.sqrt(np.maximum(whole[border[to]] - whole[begin], 1e-9))
            inside = np.sqrt(np.maximum(kept[border[to]] - kept[begin], 0))
            tried = np.flatnonzero((inside >= cosine * norm) & (inside >= LEAST_SHARE * items.norms[members].min()))
            tries[width] = tried, norm[tried]
            needed += np.bincount(tried, minlength=n + 1) - np.bincount(to[tried], minlength=n + 1)
        known = np.flatnonzero((at >= 0) & (np.cumsum(needed)[block] > 0))
        # Blocks behind the last let every window be added up.
        parts = np.zeros((n + max(groups), latent.projection.shape[1]), np.float32)
        if len(known):
            own = block[known]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            parts[own[heads]] = row_sums(latent.projection, at[known], np.diff(np.r_[heads, len(own)]))
        numbers, hits = items.numbers(words), []
        for low in range(0, n, SIDE):
            # Windows of so many blocks from every block, each width from the one before; at the end of a row they are shorter.
            high = min(low + SIDE, n)
            room = last_block[low:high] - np.arange(low, high)
            sums, added = np.zeros((high - low, parts.shape[1]), np.float32), 0
            for width, members in groups.items():
                for j in range(added, width):
                    full = np.flatnonzero(room <= j)
                    ended = sums[full]
                    sums += parts[low + j: high + j]
                    sums[full] = ended
                added = width
                tried, norm = (x[slice(*np.searchsorted(tries[width][0], (low, high)))] for x in tries[width])
                least = LEAST_SHARE * items.norms[members]
                product = sums[tried - low] @ items.vectors[members].T
                # Only windows whose best item may be near are looked at item by item.
                some = np.flatnonzero(product.max(axis=1) >= 0.999 * np.maximum(cosine * norm, least.min()))
                product = product[some]
                near = product / norm[some, None]
                b, m = np.nonzero((near >= cosine) & (product >= least))
                hits.append((width, tried[some[b]], members[m], near[b, m]))
        found = []
        for width in groups:
            here, item, near = (np.concatenate(x) for x in zip(*(h[1:] for h in hits if h[0] == width)))
            # A block more on both sides holds an item that begins inside a block.
            start = np.maximum(first[row_of[here]], begin[here] - STEP)
            stop = np.minimum(first[row_of[here] + 1], begin[here] + (width + 1) * STEP)
            together = max(1, (1 << 20) // ((width + 2) * (width // 8 + 1) * STEP))
            for low in range(0, len(here), together):
                span = slice(low, low + together)
                places, shared, answer = verified(numbers, start[span], stop[span], item[span])
                found.append((row_of[here[span]][places], item[span][places], near[span][places], shared, answer))
        row, item, near, shared, answer = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
        best = np.lexsort((-shared, item, row))
        best = best[np.r_[True, (np.diff(row[best]) != 0) | (np.diff(item[best]) != 0)][: len(best)]]
        return list(zip(row[best].tolist(), item[best].tolist(), near[best].tolist(), shared[best].tolist(), answer[best].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for base, words, first in packed_words(batch.column(1)):
                if len(words) and groups:
                    found += [(batch.column(0)[base + r].as_py(), items.ids[k], near, shared / items.lengths[k], answer)
                              for r, k, near, shared, answer in piece(words, first)]
            if found:
                cols = list(zip(*found))
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())],
                    ["row", "item", "cosine", "shared", "answer"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
               answer: str | None = None, cosine: float = 0.45, common: float = 0.6, weaker: float = 0.45) -> DataFrame:
    """(row, item, cosine, shared, answer): for each row of ``docs`` the items it holds, exactly or in other words.

    ``row`` is the row's place, monotonically_increasing_id() of ``docs``, which should be a stored table.  All windows of all
    texts, at steps of 8 words and of each item's length, are compared with every item in the latent space of
    :func:`fit_latent`.  A window at ``cosine`` or more counts if the longest common subsequence of words has
    ``common`` of the item's words, or ``weaker`` of them and the whole answer (the column ``answer``, else the
    item's last sentence).  Words are lower case without ASCII punctuation.

    The items are the query set: they are read in blocks of 512, each block searched over all rows.  Null texts and
    items, and those without words, match nothing; repeated rows and items each count.
    """
    row, = fresh(docs, "row_id")
    placed = docs.select(F.monotonically_increasing_id().alias(row), whole_text(text).alias("text"))
    words = cut_lineage(placed.mapInArrow(as_words, "row bigint, words binary"))
    item_words = cut_lineage(benchmark.select(F.lit(0).cast("bigint").alias("row"), whole_text(item_text).alias("text"))
                             .mapInArrow(as_words, "row bigint, words binary"))
    latent = fit_latent(words, item_words)
    last_sentence = F.regexp_extract(item_text, r"([^.!?\n]*[^.!?\s][^.!?\n]*)[.!?\s]*$", 1)
    given = benchmark.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text"),
        F.coalesce(F.col(answer) if answer else last_sentence, F.lit("")).alias("answer"))
    out, block = None, []

    def flush():
        nonlocal out, block
        part = words.mapInArrow(
            search(Items([r[0] for r in block], [r[1] for r in block], [r[2] for r in block], latent), latent,
                   cosine, common, weaker), "row bigint, item bigint, cosine double, shared double, answer boolean")
        out, block = part if out is None else out.unionByName(part), []

    for r in given.toLocalIterator():
        block.append(r)
        if len(block) == ITEMS:
            flush()
    if block or out is None:
        flush()
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with leaked_items: the sorted ids of the benchmark items each text holds, else empty."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "leaked_items"])
    row, other = fresh(docs, "row_id", "row_ref")
    leaks = find_leaks(docs, benchmark, text, **options).groupBy(F.col("row").alias(other)).agg(
        F.array_sort(F.collect_set("item")).alias("leaked_items"))
    return (docs.withColumn(row, F.monotonically_increasing_id()).join(leaks, F.col(row) == F.col(other), "left")
            .withColumn("leaked_items", F.coalesce("leaked_items", F.array().cast("array<bigint>")))
            .select(*docs.columns, "leaked_items"))
