"""Hard negatives against plain sorting of all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import negatives

KIND = "vec_id bigint, embedding array<double>, label int, planes string, stripe int"


def brute(rows, positives=5, keep=3, low=50, high=95):
    valid = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, label in valid:
        if i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v)), j, other) for j, v, other in valid))
        for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:keep]
            out += [(i, j, k, n, -p, -q) for k, (q, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], KIND)
    out = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def some_rows(n, width, seed, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        # A third of the rows is one vector, so that scores tie.
        v = centres[0] if i % 3 == 0 else [x + rng.gauss(0, spread / 2) for x in centres[c]]
        rows.append((i, v, rng.choice([c, (c + 1) % 4])))
    return rows


@pytest.mark.parametrize("width", [1, 8, 13, 64])
def test_same_as_sorting_all_products(spark, width):
    rows = some_rows(420, width, width)
    want = brute(rows)
    assert mined(spark, rows) == want and (width == 1 or want)


def test_many_cells_give_the_same(spark, monkeypatch):
    rows = some_rows(700, 10, 5)
    want = brute(rows)
    for name, value in (("STRIPE", 90), ("ANCHORS", 4), ("ROWS", 32), ("COLUMNS", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, [nan, 1.0], 1), (101, [inf, 1.0], 1), (102, [-inf, 1.0], 1), (103, [None, 1.0], 1), (104, None, 1), (105, [1.0, 1.0], None),
           (None, [1.0, 1.0], 1), (150, [], 1), (151, [0.7], 1), (152, [], 2), (200, [-1.0, -0.004], 2), (201, [0.25, 0.5], 2), (202, [0.25, 0.5], 1)]
    rows = odd + some_rows(60, 2, 9)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, odd[:7]) == [] and mined(spark, []) == []
    # An anchor at 0: its positives score 0, and so do all others.
    assert [r for r in mined(spark, rows) if r[0] == 150] and all(r[4:] == (0, 0) for r in mined(spark, rows) if r[0] == 150)
    # Too large to be counted exactly.
    assert mined(spark, [(50, [1e30], 1), (51, [1.0], 1), (52, [0.7], 2)]) == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.9, 0.0], 2), (52, [0.9, 0.0], 2)]
    out = mined(spark, rows)
    assert out == brute(rows)
    # Two anchors, each with two positives 51, each with two negatives 52.
    assert len(out) == 8 and {r[:2] for r in out} == {(50, 51)}


def test_large_numbers_are_exact(spark):
    rows = [(i, [(-1) ** j * 99_991.3 / (1 + (i * j) % 7) for j in range(40)], i % 2) for i in range(80)]
    assert mined(spark, rows) == brute(rows) != []


def test_lookups_are_products():
    rng = np.random.default_rng(3)
    for width, planes, top in ((64, 9, 255), (5, 4, 7), (16, 27, 1 << 26)):
        a, c = rng.integers(-top - 1, top + 1, (7, width)), rng.integers(-top - 1, top + 1, (50, width))
        got = negatives.scores(negatives.packed_planes(c, planes), negatives.subset_sums(a, np.int64))
        assert (got == c @ a.T).all()
