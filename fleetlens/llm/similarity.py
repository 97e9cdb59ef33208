"""Join texts whose word shingles are alike, with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import U64, mixed, seeded, shingle_hashes, signed, text_buffers, word_hashes
from fleetlens.llm.components import connected_components
from fleetlens.llm.tables import fresh, whole_text
from fleetlens.session import cut_lineage

#: Values compared for a pair, in steps; bands of candidate search.
HASHES, ROWS_PER_BAND = 160, 5
STEPS = (32, 64, 96, 160)
BLOCK = 256


def text_key(text: str = "text"):
    """63 bits of the text's digest; null is the empty text."""
    return F.conv(F.substring(F.md5(whole_text(text)), 2, 15), 16, 10).cast("bigint")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each step n, the fewest equal values with which a pair stays.

    With a uniform prior, P(likeness >= t | m of n equal) is P(Binomial(n + 1, t) <= m); a pair goes when that is
    below the tolerance.
    """
    out = {}
    for n in STEPS:
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text) to (tid, copies, sketch): 160 MinHash values of 16 bits, null without words; once per batch and text."""
    factors = (seeded(HASHES, 41) >> U64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (seeded(HASHES, 43) >> U64(32)).astype(np.uint32)
    for batch in batches:
        tid = batch.column(0).to_numpy()
        ids, at, copies = np.unique(tid, return_index=True, return_counts=True)
        texts = batch.column(1).take(pa.array(at))
        out: list = [None] * len(ids)
        for low, _, buf, offsets in text_buffers(texts, lower=True):
            words, first = word_hashes(buf, offsets)
            shingles, begin = shingle_hashes(words, first)
            rows = np.flatnonzero(np.diff(begin))
            if not len(rows):
                continue
            x = (shingles >> U64(32)).astype(np.uint32)
            least = np.empty((len(rows), HASHES), np.uint32)
            for k in range(HASHES):
                least[:, k] = np.minimum.reduceat(x * factors[k] + shifts[k], begin[rows])
            values = (mixed(least.astype(U64)) >> U64(48)).astype(np.uint16)
            for r, v in zip(rows, values):
                out[low + r] = v.tobytes()
        yield pa.record_batch([pa.array(ids), pa.array(copies), pa.array(out, pa.binary())], ["tid", "copies", "sketch"])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, sketch) to (tid, band): a 64-bit key per band."""
    n = HASHES // ROWS_PER_BAND
    factors, offsets = seeded(HASHES, 51) | U64(1), seeded(n, 53)
    for batch in batches:
        values = sketch_matrix(batch.column(1)).astype(U64) + U64(1)
        keys = mixed((values * factors).reshape(-1, n, ROWS_PER_BAND).sum(axis=2, dtype=U64) + offsets)
        yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), n)), signed(keys.ravel())], ["tid", "band"])


def sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its sorted distinct shingle hashes."""
    for batch in batches:
        out = []
        for _, _, buf, offsets in text_buffers(batch.column(batch.num_columns - 1), lower=True):
            shingles, begin = shingle_hashes(*word_hashes(buf, offsets))
            out += [np.unique(shingles[a:b]).tobytes() for a, b in zip(begin, begin[1:])]
        yield pa.record_batch([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "shingles"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from products of membership matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        member = np.zeros((len(sets), width), np.float32)
        member[owner[a:b], column[a:b] - low] = 1
        out += (member @ member.T).astype(np.int64)
    return out


def linked_pairs(left: np.ndarray, values: np.ndarray, sets: list[np.ndarray], threshold: float, least: dict[int, int],
                 same_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks (``left`` marks the first) with likeness of at least ``threshold``, exactly."""
    if same_block:
        a, b = np.triu_indices(len(left), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(left), np.flatnonzero(~left), indexing="ij"))
    equal, done = np.zeros(len(a), np.int32), 0
    for n in STEPS:
        if not len(a):
            return a, b
        for k in range(done, n):
            equal += values[a, k] == values[b, k]
        stay = equal >= least[n]
        a, b, equal, done = a[stay], b[stay], equal[stay], n
    sizes = np.array([len(s) for s in sets])
    if len(a) <= 64:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    else:
        shared = shared_counts(sets)[a, b]
    alike = shared >= threshold * (sizes[a] + sizes[b] - shared) - 1e-9
    return a[alike], b[alike]


def block_links(threshold: float, tolerance: float):
    """A mapper of rows (comp, i, j, block, tid, copies, sketch, shingles), grouped by (comp, i, j), to
    (tid, links, root): weighted links inside that pair of blocks, and the smallest member reached through them."""
    least = least_matches(threshold, tolerance)

    def solve(rows: list[tuple]) -> list[tuple[int, int, int]]:
        comp, i, j = rows[0][:3]
        tid = np.array([r[4] for r in rows], np.int64)
        copies = np.array([r[5] for r in rows], np.int64)
        left = np.array([r[3] == i for r in rows])
        values = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(r[7], U64) for r in rows]
        a, b = linked_pairs(left, values, sets, threshold, least, i == j)
        links = np.zeros(len(tid), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = tid.copy()
        while len(a):
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, root[a])
            if (root == before).all():
                break
        return [x for x in zip(tid.tolist(), links.tolist(), root.tolist()) if x[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []

        def packed():
            t, n, r = zip(*out)
            return pa.record_batch([pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64())],
                                   ["tid", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][:3] != row[:3]:
                    out += solve(rows) if len(rows) > 1 else []
                    rows = []
                rows.append(row)
            if out:
                yield packed()
                out = []
        if len(rows) > 1:
            out += solve(rows)
        if out:
            yield packed()
    return run


def text_classes(docs: DataFrame, text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """(tid, copies, links, root) of each different text that has a like one.

    ``tid`` is :func:`text_key`; ``links`` counts the documents, copies included, of other texts whose sets of lower
    case word 5-grams have a Jaccard likeness of ``threshold`` or more; ``root`` is the smallest tid of the class.

    Equal texts are folded inside each batch and then by key, so copies never meet in one place.  Texts that share a
    band of their MinHash sketch are candidates (a pair at 0.8 shares none of 32 bands with probability 3e-6); only
    the smallest text of a bucket is paired with its others, which gives components of candidates.  A component is
    cut into blocks of 256 texts, each pair of blocks is one unit of work, and inside it every pair is compared step
    by step, dropped when it can hardly reach the threshold, and otherwise counted exactly.
    """
    keyed = docs.select(text_key(text).alias("tid"), whole_text(text).alias("text"))
    texts = cut_lineage(
        keyed.mapInArrow(sketches, "tid bigint, copies bigint, sketch binary")
        .groupBy("tid").agg(F.sum("copies").alias("copies"), F.first("sketch").alias("sketch")))
    rows = texts.filter("sketch is not null").select("tid", "sketch").mapInArrow(bands, "tid bigint, band bigint")
    pivots = rows.groupBy("band").agg(F.min("tid").alias("pivot"), F.max("tid").alias("last")).filter("pivot != last")
    candidates = rows.join(pivots.drop("last"), "band").filter("tid != pivot").select("tid", "pivot").distinct()
    groups = cut_lineage(connected_components(candidates, "tid", "pivot").withColumnsRenamed({"node": "tid", "root": "comp"}))
    sizes = groups.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "comp").join(texts, "tid").select(
        "comp", "blocks", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int").alias("block"), "tid", "copies", "sketch")
    one_text = keyed.groupBy("tid").agg(F.first("text").alias("text"))
    # A component of n texts makes about n / 512 pairs of blocks; a text goes to as many as there are blocks.
    paired = (
        members.join(one_text, "tid").select("comp", "blocks", "block", "tid", "copies", "sketch", "text")
        .mapInArrow(shingle_sets, "comp bigint, blocks int, block int, tid bigint, copies bigint, sketch binary, shingles binary")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "tid", "copies", "sketch", "shingles"))
    solved = cut_lineage(
        paired.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "tid")
        .mapInArrow(block_links(threshold, tolerance), "tid bigint, links bigint, root bigint"))
    roots = connected_components(solved, "tid", "root")
    links = solved.groupBy("tid").agg(F.sum("links").alias("links"))
    return links.join(roots, links["tid"] == roots["node"]).join(texts.select(F.col("tid").alias("t"), "copies"), F.col("tid") == F.col("t")) \
        .select("tid", "copies", "links", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8,
                    tolerance: float = 1e-6) -> DataFrame:
    """All columns of ``docs`` with ``class_id``, the smallest key of the document's class, and ``n_links``, the number
    of other documents (copies of the same text included) at ``threshold`` or more.

    A class holds everything that links connect.  Null is the empty text; texts without words are alike only if equal.
    Equal rows are copies.  Null keys are never a class's id unless the class has no other.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("class_id", "n_links")])
    tid, root, copies, links, other = fresh(docs, "tid", "root_id", "n_copies", "n_near", "other_id")
    classes = cut_lineage(text_classes(docs, text, threshold, tolerance)).select(
        F.col("tid").alias(other), F.col("root").alias(root), F.col("links").alias(links))
    keyed = docs.withColumn(tid, text_key(text)).join(classes, F.col(tid) == F.col(other), "left").drop(other) \
        .withColumn(root, F.coalesce(root, tid))
    own = docs.groupBy(text_key(text).alias(other)).agg(F.count(F.lit(1)).alias(copies))
    firsts = (docs.select(key, text_key(text).alias(tid)).join(classes, F.col(tid) == F.col(other), "left")
              .groupBy(F.coalesce(root, tid).alias(root)).agg(F.min(key).alias("class_id")))
    return (
        keyed.join(own, F.col(tid) == F.col(other)).drop(other).join(firsts, root)
        .withColumn("n_links", F.coalesce(links, F.lit(0)) + F.col(copies) - 1)
        .select(*docs.columns, "class_id", "n_links"))


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8,
                  tolerance: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the text with the smallest key stays, once.

    Of rows with equal key and text one stays; with null keys only, the one with the smallest text digest.
    """
    tid, root, other, pid, best = fresh(docs, "tid", "root_id", "other_id", "pid", "best_pid")
    classes = cut_lineage(text_classes(docs, text, threshold, tolerance)).select(
        F.col("tid").alias(other), F.col("root").alias(root))
    keyed = docs.withColumn(tid, text_key(text)).withColumn(pid, F.xxhash64(key, tid))
    # The keepers: per class the smallest (key, text); only keys and digests are moved.
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(tid).alias("tid"), F.col(pid).alias("pid"))
    keep = (keyed.select(key, tid, pid).join(classes, F.col(tid) == F.col(other), "left")
            .groupBy(F.coalesce(root, tid).alias(root)).agg(F.min(order).alias("k"))
            .select(F.col("k.pid").alias(best), F.col("k.tid").alias(other)))
    return (
        keyed.join(keep, (F.col(pid) == F.col(best)) & (F.col(tid) == F.col(other)), "left_semi")
        .dropDuplicates([pid, tid]).select(*docs.columns))
