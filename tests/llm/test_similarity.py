from __future__ import annotations

import random

from fleetlens.llm import similarity as sim
from fleetlens.llm.components import connected_components


def brute(texts: list, threshold: float = 0.8):
    """(class id, links) of each text, by comparing all pairs of sets of word 5-grams."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            shared = len(x & y)
            same = (texts[a] or "") == (texts[b] or "")
            if same or (shared and shared >= threshold * (len(x) + len(y) - shared) - 1e-9):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(find(i), links[i]) for i in range(len(texts))]


def near_copies(base: str, n: int, seed: int, edits: int) -> list[str]:
    rng, out = random.Random(seed), []
    for i in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        out.append(" ".join(w))
    return out


def result(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_classes_and_links_equal_all_pairs(docs_of, words, monkeypatch):
    base = words(90, 1)
    texts = [words(60, i) for i in range(2, 12)] + near_copies(base, 60, 3, 5) + [base] * 9 + ["a b", "a b", "A  b", "a c", "", None, " "]
    texts += near_copies(words(20, 50), 12, 4, 2)
    want = dict(enumerate(brute(texts)))
    docs = docs_of(texts)
    assert result(sim.near_duplicates(docs)) == want
    monkeypatch.setattr(sim, "BLOCK", 16)  # many pairs of blocks in a group
    assert result(sim.near_duplicates(docs.repartition(3))) == want
    kept = sim.one_per_class(docs)
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _ in want.values()} and kept.columns == docs.columns


def test_pruning_bound_is_the_posterior():
    least = sim.least_matches(0.8, 1e-6)
    assert all(0 < least[n] < 0.8 * n for n in sim.STEPS)
    assert least[160] / 160 > least[32] / 32


def test_repeated_rows_null_keys_clashing_columns_and_empty_tables(spark, docs_of, words):
    docs = docs_of([words(30, 1)] * 3 + [words(30, 2)])
    twice = docs.union(docs).selectExpr("IF(doc_id = 2, NULL, doc_id) AS doc_id", "text", "lang AS tid", "source AS root_id", "n_chars AS n_links")
    rows = sim.near_duplicates(twice).collect()
    assert sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in rows) == sorted(
        [("0", 0, 5), ("0", 0, 5), ("1", 0, 5), ("1", 0, 5), ("None", 0, 5), ("None", 0, 5), ("3", 3, 1), ("3", 3, 1)])
    assert sorted(r["doc_id"] for r in sim.one_per_class(twice).collect()) == [0, 3]
    assert sim.one_per_class(docs.limit(0)).count() == 0 and sim.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
