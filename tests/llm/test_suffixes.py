from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from fleetlens.llm import suffixes


def by_hand(texts: list, length: int):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, texts, length=200):
    rows = {r["doc_id"]: tuple(r)[1:] for r in suffixes.digest_repeats(docs, length=length).collect()}
    assert [rows[i] for i in range(len(texts))] == by_hand(texts, length)


def test_equals_all_strings(docs_of, words, stored):
    rng = random.Random(3)
    shared = words(200, 1)
    texts = [words(150, i) for i in range(2, 8)] + [None, "", "x" * 199, "x" * 200, "x" * 431, "ab" * 300, "é" * 250]
    for i in range(25):
        a = rng.randrange(400)
        texts.append(words(rng.randint(0, 60), 100 + i) + shared[a: a + rng.randint(150, 700)] + words(rng.randint(0, 60), 200 + i))
    texts += [texts[2]] * 4 + [texts[2][:-1], texts[2][1:], texts[2] + "."]
    check(stored(docs_of(texts)), texts)
    check(stored(docs_of(texts).repartition(7), "more"), texts)
    check(stored(docs_of(texts), "short"), texts, 150)


def test_many_borders_of_one_passage(docs_of, words, stored):
    # Every text ends a copy of the passage elsewhere, so one sample has many different contents.
    shared = words(120, 1)
    texts = [words(8, i) + shared[i * 3: 260 + i * 7] + words(8, 90 + i) for i in range(40)]
    check(stored(docs_of(texts)), texts)


def test_repeated_rows_null_keys_clashing_columns_and_empty_tables(docs_of, words, stored):
    docs = docs_of([words(60, 1)] * 2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang AS row", "source AS flags", "n_chars AS n_bytes")
    rows = suffixes.digest_repeats(stored(docs)).collect()
    assert [(r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in rows] == [(None, True)] * 2
    assert suffixes.digest_repeats(stored(docs.limit(0), "e")).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeated_bytes(docs, length=100)
