"""Which tokens of two tokenizers stand for the same bytes, and how often each pair of ids does so in a corpus.

Both tokenizers cut space+text into tokens that lie end to end.  Offsets where tokens of both sides end cut a document into
groups; every token of one side in a group is linked with every one of the other.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.tables import shipped
from fleetlens.session import cut_lineage

#: Bytes of text worked on together; one longer text is a block of its own.
BLOCK = 4 << 20
#: A pair of ids is one number, the first id times this plus the second.
SIDE = 1 << 20
#: Groups of more links than this are first reduced to their different ids; so many links are made together.
MANY = 1 << 12
LINKS = 1 << 22
#: Values in a list of a stored row, and rows handed to Spark together: what Spark holds at once does not go by blocks or texts.
PIECE = 1 << 10
ROWS = 1 << 10
#: Kinds of a block's rows.
FIGURES, CELLS, PAIRS = range(3)
STORED = {**dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()), "groups_sha256": pa.string(), "document": pa.list_(pa.int32()),
          "slot": pa.list_(pa.int32()), "times": pa.list_(pa.int64()), "pairs": pa.list_(pa.int64()), "held": pa.list_(pa.int32())}
#: Bytes of different chunks that are encoded as one text, and groups whose texts are made together.
TEXT = 1 << 14
SLICE = 1 << 20
SPACE = 0x20
#: Chunks start at a space behind a character that is none, so no cut parts the blanks that a pattern may look at together.
#: First bytes of the encoded blanks beyond ASCII.
BLANK_LEADS = ((1, (0xC2,)), (2, (0xE1, 0xE2, 0xE3)))


class Vocabulary:
    """The bytes of each token id, laid end to end."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.texts = pa.array([str(i) for i in range(len(entries))])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[ids], self.lengths[ids])]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. of each run, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself where it prints, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A tokenizer file of the byte-level kind; strings of its special tokens are plain text."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        text = content.decode()
        self.model = Tokenizer.from_str(text)
        self.model.encode_special_tokens = True
        names = {i: s for s, i in json.loads(text)["model"]["vocab"].items()}
        names |= {i: t.content for i, t in self.model.get_added_tokens_decoder().items()}
        letters = byte_alphabet()
        self.vocabulary = Vocabulary([bytes(letters[c] for c in names[i]) for i in range(max(names) + 1)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, which begins with a space."""
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentence-piece model with byte fallback, which sets a space before each text."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                                      for i, n in enumerate(names)])
        self.blank = [self.model.piece_to_id("▁")]
        #: Pieces with a space behind something else would reach over the borders of chunks.
        self.chunks = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, which begins with the space that the model itself sets."""
        return [ids or self.blank for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]


_loaded: dict = {}


def loaded(kind: type, content: bytes):
    """A tokenizer from the bytes of its file, made once per Python process."""
    key = kind, hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded[key] = kind(content)
    return _loaded[key]


def chunk_starts(buf: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where a text may be cut without a change to its tokens: at document starts and at spaces behind no blank."""
    may = buf == SPACE
    may[1:] &= (buf[:-1] > SPACE) & (buf[:-1] != 0x7F)
    for back, leads in BLANK_LEADS:
        for lead in leads:
            may[back + 1:] &= buf[: -back - 1] != lead
    may[firsts] = True
    return np.flatnonzero(may)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, length of each list)."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Coded:
    """Tokens of strings that lie end to end: ids, tokens per string, and whether its tokens' bytes are its own.

    ``text_of`` numbers the texts that are encoded: runs of strings whose borders no token crosses.
    """

    def __init__(self, tokenizer, data: np.ndarray, lengths: np.ndarray, text_of: np.ndarray):
        vocabulary = tokenizer.vocabulary
        ends = np.cumsum(lengths)
        last = np.flatnonzero(np.append(text_of[1:] != text_of[:-1], True)) if len(lengths) else np.zeros(0, np.int64)
        text_ends = ends[last]
        raw, cuts = data.tobytes(), np.concatenate([[0], text_ends]).tolist()
        ids, counts = flat(tokenizer.encode([raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]))
        size = vocabulary.lengths[ids]
        whole = sums(size, counts) == np.diff(text_ends, prepend=0)
        kept = np.repeat(whole, counts)
        strings = np.repeat(whole, np.diff(last, prepend=-1))
        # Only texts that come back in length are looked at string by string.
        ids, own = ids[kept], lengths[strings]
        wrong = vocabulary.bytes_of(ids) != data[np.repeat(strings, lengths)]
        token_ends, own_ends = np.cumsum(vocabulary.lengths[ids]), np.cumsum(own)
        upto = np.searchsorted(token_ends, own_ends, "right")
        cut = token_ends[upto - 1] == own_ends if len(own) else np.zeros(0, bool)
        right = cut & np.append(True, cut[:-1]) & (sums(wrong, own) == 0)
        self.right = np.zeros(len(lengths), bool)
        self.right[np.flatnonzero(strings)[right]] = True
        self.counts = np.zeros(len(lengths), np.int64)
        self.counts[strings] = np.diff(upto, prepend=0)
        self.ids = ids
        odd = np.flatnonzero(~self.right)
        if len(odd) and len(last) < len(lengths):
            # A string that does not come back must not spoil those beside it.
            alone = Coded(tokenizer, data[ranges(ends[odd] - lengths[odd], lengths[odd])], lengths[odd], np.arange(len(odd)))
            self.right[odd], self.counts[odd] = alone.right, self.counts[odd]
            self.firsts = np.cumsum(self.counts) - self.counts
            self.counts[odd], self.firsts[odd] = alone.counts, len(self.ids) + alone.firsts
            self.ids = np.concatenate([self.ids, alone.ids])
        else:
            self.firsts = np.cumsum(self.counts) - self.counts

    def of(self, strings: np.ndarray) -> np.ndarray:
        """Ids of a sequence of the strings."""
        return self.ids[ranges(self.firsts[strings], self.counts[strings])]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def tokens_of(texts: list[bytes], first, second) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, number of tokens per text) for both tokenizers; texts whose bytes do not come back have none.

    Equal chunks of the texts are encoded once.  Texts with a chunk whose bytes do not come back are encoded whole.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    starts = chunk_starts(buf, firsts) if second.chunks else firsts
    coded = binary(buf, np.append(starts[1:], len(buf))[: len(starts)]).dictionary_encode()
    chunk = coded.indices.to_numpy()
    strings = coded.dictionary
    data = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
    sizes = pc.binary_length(strings).to_numpy()
    # Different chunks follow each other as in a text, up to one that another may not follow.
    ends = np.cumsum(sizes)
    loose = np.zeros(len(sizes), np.int64)
    loose[1:] = ~np.isin(ends[:-1], chunk_starts(data, np.zeros(min(1, len(data)), np.int64))) if second.chunks else True
    text_of = np.cumsum(loose) + ends // TEXT
    sides = [Coded(t, data, sizes, text_of) for t in (first, second)]
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    good = np.ones(len(texts), bool)
    good[owner[~(sides[0].right & sides[1].right)[chunk]]] = False
    odd = np.flatnonzero(~good)
    whole = []
    if len(odd):
        odd_data = np.frombuffer(b"".join(texts[i] for i in odd), np.uint8)
        whole = [Coded(t, odd_data, lengths[odd], np.arange(len(odd))) for t in (first, second)]
        back = np.flatnonzero(whole[0].right & whole[1].right)
    out = []
    for k, side in enumerate(sides):
        used = good[owner]
        ids = side.of(chunk[used])
        counts = np.bincount(owner[used], side.counts[chunk[used]], len(texts)).astype(np.int64)
        if len(odd) and len(back):
            at = (np.cumsum(counts) - counts)[odd[back]]
            own = whole[k].counts[back]
            ids = np.insert(ids, np.repeat(at, own), whole[k].of(back))
            counts[odd[back]] = own
        out.append((ids, counts))
    return out


class Groups:
    """The groups of a block of documents: which tokens of either side are in each."""

    def __init__(self, a_ids, a_counts, b_ids, b_counts, first: Vocabulary, second: Vocabulary):
        sides = []
        for ids, counts, vocabulary in ((a_ids, a_counts, first), (b_ids, b_counts, second)):
            size = vocabulary.lengths[ids]
            end = np.cumsum(size)
            sides.append(pd.DataFrame({"at": end - size, "end": end, "token": np.arange(len(ids))}))
        # Documents lie end to end, and both sides have a token at the start of each: a place is document and offset in one.
        a, b = sides
        over = [pd.merge_asof(a, b, on="at", suffixes=("_a", "_b")), pd.merge_asof(b, a, on="at", suffixes=("_b", "_a"))]
        met = np.concatenate([x["token_a"].to_numpy() * len(b) + x["token_b"].to_numpy() for x in over]) if len(b) else np.zeros(0, np.int64)
        met = np.sort(met, kind="stable")
        met = met[np.append(True, met[1:] != met[:-1])] if len(met) else met
        left, right = met // max(len(b), 1), met % max(len(b), 1)
        closes = a["end"].to_numpy()[left] == b["end"].to_numpy()[right]
        #: Number of tokens per group, and of groups per document.
        self.a_sizes = np.diff(left[closes] + 1, prepend=0)
        self.b_sizes = np.diff(right[closes] + 1, prepend=0)
        self.per_document = np.diff(np.searchsorted(left[closes] + 1, np.cumsum(a_counts), "right"), prepend=0)
        self.a_ids, self.b_ids = a_ids, b_ids

    def slices(self) -> Iterator[tuple[int, int]]:
        """Ranges of groups with about LINKS links each, where a group of many counts as MANY."""
        upto = np.cumsum(np.minimum(self.a_sizes * self.b_sizes, MANY))
        lo = 0
        while lo < len(upto):
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINKS)) + 1
            yield lo, min(hi, len(upto))
            lo = hi

    def links(self, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair of ids, how often) of all links of a range of groups; a pair may stand several times for a group."""
        links = self.a_sizes * self.b_sizes
        inside = np.zeros(len(links), bool)
        inside[lo:hi] = True
        few = inside & (links <= MANY)
        a_first, b_first = np.cumsum(self.a_sizes) - self.a_sizes, np.cumsum(self.b_sizes) - self.b_sizes
        group = np.repeat(np.flatnonzero(few), links[few])
        k = ranges(np.zeros(few.sum(), np.int64), links[few])
        width = self.b_sizes[group]
        pair = self.a_ids[a_first[group] + k // width] * SIDE + self.b_ids[b_first[group] + k % width]
        parts = [(group, pair, np.ones(len(pair), np.int64))]
        for g in np.flatnonzero(inside & (links > MANY)):
            a, n = np.unique(self.a_ids[a_first[g]: a_first[g] + self.a_sizes[g]], return_counts=True)
            b, m = np.unique(self.b_ids[b_first[g]: b_first[g] + self.b_sizes[g]], return_counts=True)
            parts.append((np.full(len(a) * len(b), g), (a[:, None] * SIDE + b).ravel(), np.outer(n, m).ravel()))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def digests(self, first: Vocabulary, second: Vocabulary) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document, '' without groups."""
        def joined(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), vocabulary.texts.take(pa.array(ids)))
            return pc.binary_join(lists, ",")

        hashes = [hashlib.sha256() if n else None for n in self.per_document]
        begun = np.zeros(len(hashes), bool)
        ends = np.cumsum(self.per_document)
        a_ends, b_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (self.a_sizes, self.b_sizes))
        for lo in range(0, len(self.a_sizes), SLICE):
            hi = min(lo + SLICE, len(self.a_sizes))
            groups = pc.binary_join_element_wise(
                joined(self.a_ids[a_ends[lo]: a_ends[hi]], self.a_sizes[lo:hi], first),
                joined(self.b_ids[b_ends[lo]: b_ends[hi]], self.b_sizes[lo:hi], second), "|")
            docs = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right") + 1)
            borders = pa.array(np.concatenate([[0], np.minimum(ends[docs], hi) - lo]), pa.int32())
            for d, text in zip(docs, pc.binary_join(pa.ListArray.from_arrays(borders, groups), ";").to_pylist()):
                if self.per_document[d]:
                    hashes[d].update((";" if begun[d] else "").encode() + text.encode())
                    begun[d] = True
        return [h.hexdigest() if h else "" for h in hashes]


def pieces(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values as rows of lists, PIECE values each."""
    borders = np.append(np.arange(0, len(values), PIECE), len(values))
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, kind))


def folded(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of the times of each."""
    order = np.argsort(keys)
    keys = keys[order]
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)
    return keys[last], np.diff(np.cumsum(times[order])[last], prepend=0)


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[pa.Table]:
    """The rows of a task cut into tables of about ``limit`` bytes of text (second column), over the borders of batches."""
    waiting, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lo = 0
        for hi in range(1, batch.num_rows + 1):
            size += lengths[hi - 1] + 1
            if size >= limit:
                yield pa.Table.from_batches([*waiting, batch.slice(lo, hi - lo)])
                waiting, size, lo = [], 0, hi
        if lo < batch.num_rows:
            waiting.append(batch.slice(lo))
    if waiting:
        yield pa.Table.from_batches(waiting)


def align_block(table: pa.Table, first: ByteLevel, second: Pieces) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    """(kind of row, its columns) for a block: its documents' figures, which pair of ids each document has how often, and its
    different pairs with the number of documents that have them."""
    texts = [b" " + t if t else b"" for t in table.column(1).cast(pa.large_binary()).to_pylist()]
    (a_ids, a_counts), (b_ids, b_counts) = tokens_of(texts, first, second)
    groups = Groups(a_ids, a_counts, b_ids, b_counts, first.vocabulary, second.vocabulary)
    yield FIGURES, {
        "place": pa.array(np.arange(len(texts)), pa.int32()), "id": table.column(0).combine_chunks(),
        "n_a": pa.array(a_counts, pa.int64()), "n_b": pa.array(b_counts, pa.int64()),
        "n_groups": pa.array(groups.per_document, pa.int64()),
        "n_links": pa.array(sums(groups.a_sizes * groups.b_sizes, groups.per_document), pa.int64()),
        "groups_sha256": pa.array(groups.digests(first.vocabulary, second.vocabulary), pa.string()),
    }
    owner = np.repeat(np.arange(len(texts)), groups.per_document)
    # A document and a pair in one number; equal ones are summed up, so that memory goes by what is different.
    key, times = [], []
    for lo, hi in groups.slices():
        group, pair, many = groups.links(lo, hi)
        for known, new in zip((key, times), folded(owner[group] * SIDE**2 + pair, many)):
            known.append(new)
    key, times = folded(np.concatenate(key), np.concatenate(times)) if key else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    document = key // SIDE**2
    pairs, slot = np.unique(key % SIDE**2, return_inverse=True)
    cells = pieces(document, pa.int32())
    yield CELLS, {"place": pa.array(np.arange(len(cells)), pa.int32()), "document": cells,
                  "slot": pieces(slot, pa.int32()), "times": pieces(times, pa.int64())}
    held = pieces(np.bincount(slot, minlength=len(pairs)), pa.int32())
    yield PAIRS, {"place": pa.array(np.arange(len(held)) * PIECE, pa.int32()), "pairs": pieces(pairs, pa.int64()), "held": held}


def score_block(rows: pa.Table, looked: pa.Table) -> pa.Table:
    """The documents of a block, with the sums over their links; ``looked`` has what the corpus knows of the block's pairs."""
    rows = rows.sort_by("place")
    own, cells = (rows.filter(pc.equal(rows["kind"], kind)) for kind in (FIGURES, CELLS))
    document, slot, times = (pc.list_flatten(cells[c]).to_numpy().astype(np.int64) for c in ("document", "slot", "times"))
    at = looked["at"].to_numpy()
    documents, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    documents[at], best[at] = looked["documents"].to_numpy(), looked["best"].to_numpy()
    n_pairs = np.bincount(document, minlength=len(own))
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    return pa.table(
        [own["id"], *(own[c] for c in figures), pa.array(sums(times * best[slot], n_pairs)),
         pa.array(sums(times * documents[slot], n_pairs)), own["groups_sha256"]],
        ["id", *figures, "n_best", "count_sum", "groups_sha256"])


class Alignment:
    """Two tokenizers held against each other over a table of documents.

    ``documents``: per row the id column, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that share a group), n_best
    (links whose pair of ids is in as many documents as any of its first id), count_sum (those numbers of documents over all
    links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).  ``pairs``: (a_id, b_id, documents), how many rows hold two ids linked.

    Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens: zeros and ''.  Rows with equal
    ids or texts stay rows of their own and count each.  A text may be of any length that Spark holds.  Other columns are
    ignored.  Rows are worked on in blocks of ``block`` bytes (one longer text is a block of its own); from a block only its
    different pairs are joined with the counts of the corpus, so a pair that every document has is one row per block.  What a
    block gives is stored in rows of bounded size and meets again in Python, a block at a time; Spark holds no block as a row.
    A group without common ends costs the product of its different ids, for each of these pairs has a count.
    """

    def __init__(self, docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text: str = "text", block: int = BLOCK):
        spark = docs.sparkSession
        files = shipped(spark, byte_level), shipped(spark, pieces)

        kind = docs.schema[id_column].dataType
        figures = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
        schema = T.StructType([
            *T._parse_datatype_string("block bigint, kind int, place int").fields, T.StructField("id", kind),
            *T._parse_datatype_string(f"{figures}, groups_sha256 string, document array<int>, slot array<int>, times array<bigint>, "
                                      "pairs array<bigint>, held array<int>").fields])
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = loaded(ByteLevel, files[0].value), loaded(Pieces, files[1].value)
            task = TaskContext.get().partitionId()
            for k, table in enumerate(blocks_of(batches, block)):
                for row, columns in align_block(table, first, second):
                    n = len(columns["place"])
                    columns |= {"block": pa.array(np.full(n, task << 32 | k)), "kind": pa.array(np.full(n, row), pa.int32())}
                    empty = {"id": table.schema.types[0], **STORED}
                    batch = pa.record_batch([columns[c] if c in columns else pa.nulls(n, empty[c]) for c in names], names)
                    for lo in range(0, n, ROWS):
                        yield batch.slice(lo, ROWS)

        blocks = cut_lineage(docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema))
        entries = blocks.filter(F.col("kind") == PAIRS).select(
            "block", "place", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "e")).select(
            "block", (F.col("place") + F.col("at")).alias("at"), "e.pairs", "e.held")
        counts = cut_lineage(entries.groupBy("pairs").agg(F.sum("held").alias("documents")))
        a_id = F.shiftright("pairs", SIDE.bit_length() - 1)
        # One row for each id of the first vocabulary at most.
        most = counts.groupBy(a_id.alias("a_id")).agg(F.max("documents").alias("most"))
        known = counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select(
            "pairs", "documents", (F.col("documents") == F.col("most")).alias("best"))
        looked = entries.drop("held").join(known, "pairs").select(F.col("block").alias("of_block"), "at", "documents", "best")
        out = T.StructType([T.StructField("id", kind), *T._parse_datatype_string(
            f"{figures}, n_best bigint, count_sum bigint, groups_sha256 string").fields])
        self.documents = blocks.filter(F.col("kind") != PAIRS).drop("pairs", "held").groupBy("block").cogroup(
            looked.groupBy("of_block")).applyInArrow(score_block, out).withColumnRenamed("id", id_column)
        self.pairs = counts.select(a_id.alias("a_id"), F.col("pairs").bitwiseAND(SIDE - 1).alias("b_id"), "documents")
