"""Hard negatives for training embeddings: rows of another label that come close to an anchor's true neighbours.

Scores are exact integer inner products, looked up instead of multiplied: an anchor has, for each eight components, the sums of
all 256 subsets of them; a candidate's components are bits in planes, and a byte of a plane, the bits of eight components, picks
one subset.  Planes are added with shifts, from the sign plane down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage

#: Candidates and anchors of one cell of the grid at most, which bound a task's memory.
STRIPE = 1 << 16
ANCHORS = 1 << 13
#: Scores worked out together: candidates by anchors, small enough for a core's cache.
ROWS, COLUMNS = 1 << 10, 1 << 7
#: Whole numbers of this size and above, after scaling, would let a score leave 64 bits.
LARGEST = 1 << 26


def packed_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups of eight components) bytes of whole numbers in two's complement, sign plane first."""
    rows, width = values.shape
    wide = np.zeros((rows, -(-width // 8) * 8), np.int64)
    wide[:, :width] = values
    shifts = np.arange(planes - 1, -1, -1)
    return np.packbits(((wide[:, None, :] >> shifts[None, :, None]) & 1).astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for each eight components, the sum over every subset of them."""
    count, width = anchors.shape
    groups = -(-width // 8)
    wide = np.zeros((count, groups * 8), kind)
    wide[:, :width] = anchors
    parts = wide.reshape(count, groups, 8).transpose(1, 2, 0)
    table = np.zeros((groups, 256, count), kind)
    for bit in range(8):
        # Subsets with this bit are those without it, plus the component.
        table[:, 1 << bit: 2 << bit] = table[:, : 1 << bit] + parts[:, bit: bit + 1]
    return table


def scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products from a candidate's plane bytes and the anchors' subset sums."""
    rows, depth, groups = planes.shape
    total = np.zeros((rows, table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for plane in range(depth):
        total <<= 1
        for group in range(groups):
            np.take(table[group], planes[:, plane, group], axis=0, out=part, mode="clip")
            total += part
        if plane == 0:
            np.negative(total, out=total)
    return total


def in_order(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` places by falling score, then rising id."""
    if len(score) > 4 * keep:
        # Ties with the last kept score stay in until ids decide.
        least = np.partition(score, len(score) - keep)[len(score) - keep]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:keep]]
    return np.lexsort((ids, -score))[:keep]


class Cell:
    """The candidates of a stripe and the anchors that meet them."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, planes: int, groups: int, kind: type):
        self.kind = kind
        self.ids = candidates["id"].to_numpy()
        data = b"".join(candidates["planes"].to_pylist())
        self.planes = np.frombuffer(data, np.uint8).reshape(len(self.ids), planes, groups)
        codes = pd.factorize(np.concatenate([candidates["label"].to_numpy(zero_copy_only=False), anchors["label"].to_numpy(zero_copy_only=False)]))[0]
        self.labels, self.anchor_labels = codes[: len(self.ids)], codes[len(self.ids):]
        self.anchor_ids = anchors["id"].to_numpy()
        self.vectors = np.zeros((anchors.num_rows, groups * 8), np.int64)
        for k, vector in enumerate(anchors["vector"].to_pylist()):
            self.vectors[k, : len(vector)] = vector

    def tables(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchors, their subset sums), some at a time."""
        for lo in range(0, len(chosen), COLUMNS):
            some = chosen[lo: lo + COLUMNS]
            yield some, subset_sums(self.vectors[some], self.kind)

    def positives(self, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, scores): the nearest of its label here."""
        for label in np.unique(self.anchor_labels):
            own = np.flatnonzero(self.labels == label)
            ids = self.ids[own]
            for some, table in self.tables(np.flatnonzero(self.anchor_labels == label)):
                found = np.concatenate([scores(self.planes[own[lo: lo + ROWS]], table) for lo in range(0, len(own), ROWS)]) if len(own) else None
                for column, anchor in enumerate(some) if len(own) else ():
                    other = np.flatnonzero(ids != self.anchor_ids[anchor])
                    score = found[other, column].astype(np.int64)
                    first = in_order(score, ids[other], keep)
                    yield anchor, own[other[first]], score[first]

    def negatives(self, limits: list[list[int]], keep: int, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, which positive, candidates, scores): the first of another label within the positive's window here."""
        for some, table in self.tables(np.flatnonzero([len(x) > 0 for x in limits])):
            tops = np.array([max(limits[a]) for a in some], np.int64)
            lows = np.array([min(limits[a]) for a in some], np.int64)
            # Whole bounds: 100 s <= high p, and 100 s >= low p.
            most, least = tops * high // 100, -(-lows * low // 100)
            near: list[list] = [[] for _ in some]
            for lo in range(0, len(self.ids), ROWS):
                found = scores(self.planes[lo: lo + ROWS], table)
                wanted = (found <= most) & (found >= least) & (self.labels[lo: lo + ROWS, None] != self.anchor_labels[some])
                row, column = np.nonzero(wanted)
                score = found[row, column].astype(np.int64)
                order = np.argsort(column, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(column[order])) + 1) if len(order) else ():
                    near[column[part[0]]].append((row[part] + lo, score[part]))
            for column, anchor in enumerate(some):
                if near[column]:
                    row, score = (np.concatenate(x) for x in zip(*near[column]))
                    for k, positive in enumerate(limits[anchor]):
                        fits = np.flatnonzero((100 * score <= high * positive) & (100 * score >= low * positive))
                        first = fits[in_order(score[fits], self.ids[row[fits]], keep)]
                        if len(first):
                            yield anchor, k, row[first], score[first]


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors that ``is_anchor`` selects.

    A component x counts as floor(scale * x); a score is the whole inner product with the anchor; higher ones come first, then
    smaller ids.  An anchor's positives are its first ``positives`` other rows of its label; a positive's negatives the first
    ``negatives`` rows of another label whose score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null id, label, vector or component, a component that is not finite or from 2^26 up after scaling take no part.
    Shorter vectors count as filled up with zeros, an empty one as all zeros.  Rows of a repeated id are rows of their own, as
    anchors too, but none is a positive of its own id.  Negative positives have no window; of a positive at 0, negatives are at 0.
    An empty table gives an empty result; other columns are ignored.

    Candidates and anchors are dealt evenly over a grid whose cells have at most 65 536 and 8 192 of them; each cell keeps
    the first few per anchor, and windows cut these before they are shuffled.  Scores are worked out twice: for positives among
    rows of the anchor's label, then, with the positives known, for negatives among all others.
    """
    x = F.lit(float(scale))
    whole = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * x))
    # NaN is above every number here.
    fits = F.forall(F.col(vector), lambda v: F.coalesce(F.abs(v.cast("double") * x) < LARGEST, F.lit(False)))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                          is_anchor.alias("anchor"), F.when(fits, whole).alias("vector")).filter(
        "id is not null and label is not null and vector is not null")
    spark = vectors.sparkSession
    count, anchor_count, most, width = rows.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1)),
        F.max(F.array_max(F.transform("vector", F.abs))), F.max(F.size("vector"))).first()
    most, width = most or 0, max(width or 0, 1)
    planes, groups = int(most).bit_length() + 1, -(-width // 8)
    kind = np.int32 if most * most * groups * 8 < 1 << 30 else np.int64
    tasks = 2 * spark.sparkContext.defaultParallelism
    stripes = max(1, -(-count // STRIPE), min(tasks, count // ROWS))
    sides = max(1, -(-anchor_count // ANCHORS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, groups * 8), np.int64)
            for k, one in enumerate(batch.column(2).to_pylist()):
                values[k, : len(one)] = one
            packed = packed_planes(values, planes)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in packed], pa.binary())], ["id", "label", "planes"])

    # Dealt round, so that neither copies nor common labels meet; written at once, so that numbers of parts and rows stay.
    candidates = cut_lineage(rows.select("id", "label", "vector").mapInArrow(pack, "id bigint, label string, planes binary")
                             .repartition(stripes).withColumn("stripe", F.spark_partition_id()))
    anchors = cut_lineage(rows.filter("anchor").select("id", "label", "vector").repartition(sides)
                          .withColumn("side", F.spark_partition_id()).withColumn("key", F.monotonically_increasing_id()))
    cells = stripes * sides

    def grid(chosen: DataFrame, look, schema: str) -> DataFrame:
        a = chosen.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).repartition(cells, "stripe", "side")
        c = candidates.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).repartition(cells, "stripe", "side")
        names = [part.split()[0] for part in schema.split(",")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64())] * len(names), names)
            return pa.table([pa.array(np.asarray(x, np.int64)) for x in look(left, Cell(left, right, planes, groups, kind))], names)

        return a.groupBy("stripe", "side").cogroup(c.groupBy("stripe", "side")).applyInArrow(run, schema)

    def ends(parts: list[tuple], n: int) -> list:
        return [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * n

    def nearest(left: pa.Table, cell: Cell) -> list:
        key = left["key"].to_numpy()
        return ends([(np.full(len(c), key[a]), cell.ids[c], s) for a, c, s in cell.positives(positives)], 3)

    def hardest(left: pa.Table, cell: Cell) -> list:
        key = left["key"].to_numpy()
        return ends([(np.full(len(c), key[a]), np.full(len(c), k), cell.ids[c], s)
                     for a, k, c, s in cell.negatives(left["limits"].to_pylist(), negatives, low, high)], 4)

    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "other"))
    first = grid(anchors, nearest, "key bigint, other bigint, score bigint").withColumn("place", place).filter(F.col("place") <= positives)
    chosen = cut_lineage(anchors.join(first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("own")), "key")
                         .withColumn("limits", F.col("own.score")))
    rank = F.row_number().over(Window.partitionBy("key", "k").orderBy(F.desc("score"), "other"))
    found = grid(chosen.drop("own"), hardest, "key bigint, k bigint, other bigint, score bigint").withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return found.join(chosen.select("key", F.col("id").alias("anchor_id"), "own"), "key").select(
        "anchor_id", F.element_at("own", (F.col("k") + 1).cast("int")).alias("own"), "rank", F.col("other").alias("negative_id"),
        F.col("score").alias("negative_score")).select(
        "anchor_id", F.col("own.other").alias("positive_id"), "rank", "negative_id", F.col("own.score").alias("positive_score"), "negative_score")
