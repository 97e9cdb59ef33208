from __future__ import annotations

import re
from collections import defaultdict

from fleetlens.llm import mixing


def fill(sizes: dict, weights: dict, epochs: int) -> dict:
    """Round by round: share the rest by weight, clamp what is above, share again."""
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped and sizes[s]]
        rest, weight = total - sum(clamped.values()), sum(weights[s] for s in free)
        target = {s: rest * weights[s] / weight for s in free} if weight else {}
        above = [s for s in free if target[s] > epochs * sizes[s]]
        if not above:
            return {s: clamped.get(s, target.get(s, 0.0)) for s in sizes}
        clamped |= {s: float(epochs * sizes[s]) for s in above}


def test_targets_and_taken_words(docs_of, words):
    texts = [words(5 + i * 7 % 90, i) for i in range(240)] + ["a b", "c", None, ""]
    sources = {i: f"s{i % 5}" for i in range(240)} | {240: "tiny", 241: "tiny", 242: None, 243: None}
    rows = mixing.mix(docs_of(texts, sources=sources)).collect()
    assert len(rows) == len(texts)
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(dict(sizes), {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert want["tiny"] == 9.0 and want[None] == 0
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_reruns_agree_whatever_the_partitions(docs_of, words):
    docs = docs_of([words(30, i) for i in range(60)])
    first = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert first == again


def test_slices_follow_the_order_of_one_window(docs_of, words, monkeypatch):
    docs = docs_of([words(20 + i % 11, i) for i in range(150)], sources={i: "one" for i in range(100)})
    whole = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "SLICE_ROWS", 8)
    assert whole == {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}


def test_given_weights_empty_tables_and_clashing_columns(spark, docs_of, words):
    docs = docs_of([words(10, 1), words(10, 2)], sources={0: "a", 1: "b"})
    weights = spark.createDataFrame([("a", 1.0), ("b", None)], "source string, weight double")
    rows = {r["source"]: r for r in mixing.mix(docs.selectExpr("*", "'x' AS digest", "7 AS size", "1 AS s"), weights).collect()}
    assert (rows["a"]["taken"], rows["b"]["taken"]) == (20, 0) and rows["a"]["digest"] == "x"
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_are_counted_each(docs_of):
    docs = docs_of(["a b c", "a b c"]).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "'s' AS source", "n_chars")
    assert sum(r["taken"] for r in mixing.mix(docs.union(docs)).collect()) == 12
