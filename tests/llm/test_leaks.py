from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from fleetlens.llm import leaks


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(50):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.subsequence_length(np.array(a), [np.array(b)])[0] == table[-1][-1]


def test_exact_and_paraphrased_passages_and_nothing_else(spark, docs_of, words, stored):
    rng = random.Random(2)
    items = [words(rng.randint(18, 50), 1000 + i, 5000) for i in range(30)]
    texts, want = [words(rng.randint(20, 400), i, 5000) for i in range(150)], set()
    for i, item in enumerate(items):
        changed = item.split()
        for k in rng.sample(range(len(changed)), len(changed) // 6 if i % 2 else 0):
            changed[k] = "other"
        texts[i * 3] = f"{words(rng.randint(0, 40), 500 + i, 5000)} {' '.join(changed).upper()}, {words(60, 700 + i, 5000)}"
        want.add((i * 3, i))
    docs = stored(docs_of([*texts, None, "", items[0], items[0]]).selectExpr("*", "1 AS row", "2 AS words"))
    want |= {(152, 0), (153, 0)}
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (None, "x y z"), (99, "")], "item_id bigint, text string")
    got = {(r["doc_id"], i) for r in leaks.with_leaks(docs, benchmark).collect() for i in r["leaked_items"]}
    assert got == want
    rows = leaks.find_leaks(docs, benchmark).collect()
    assert all(r["shared"] >= 0.6 or r["answer"] for r in rows)


def test_items_in_blocks(spark, docs_of, words, stored, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS", 2)
    items = [words(30, 900 + i, 5000) for i in range(5)]
    docs = stored(docs_of([words(50, i, 5000) + " " + items[i] for i in range(5)]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r["doc_id"], *r["leaked_items"]) for r in leaks.with_leaks(docs, benchmark).collect()} == {(i, i) for i in range(5)}


def test_empty_tables(spark, docs_of, words, stored):
    docs = stored(docs_of([words(50, 1)]))
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, words(50, 1))], "item_id bigint, text string")
    assert [r["leaked_items"] for r in leaks.with_leaks(docs, none).collect()] == [[]]
    assert leaks.with_leaks(stored(docs.limit(0), "e"), one).count() == 0


def test_items_of_documents_that_are_a_third_of_all_rows(spark, docs_of, words, stored):
    item, other = words(30, 900, 5000), words(24, 901, 5000)
    copied = f"{words(40, 902, 5000)} {item} {words(45, 903, 5000)}"
    texts = [words(120, i, 5000) for i in range(120)]
    want = set()
    for i in range(0, 60):
        # Copies, each behind a beginning of its own length; another item in surroundings of its own.
        texts[i] = f"{words(i % 7, 300 + i, 5000)} {copied}".strip() if i % 3 else f"{words(50, 400 + i, 5000)} {other} {words(45, 500 + i, 5000)}"
        want.add((i, 0 if i % 3 else 1))
    docs = stored(docs_of(texts))
    benchmark = spark.createDataFrame([(0, item), (1, other)], "item_id bigint, text string")
    assert {(r["doc_id"], i) for r in leaks.with_leaks(docs, benchmark).collect() for i in r["leaked_items"]} == want


def test_passages_count_once_wherever_they_stand(spark, docs_of, words, stored):
    text = words(400, 5, 5000)
    def counted(texts):
        batch, = leaks.as_words([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])])
        parts = list(leaks.distinct_passages(1)([batch.select([1])]))
        row, = leaks.passage_frequencies(parts)
        return np.frombuffer(row.column(0)[0].as_py(), np.int64), row.column(1)[0].as_py()
    once, n = counted([text])
    many, m = counted([text] * 50 + [f"{words(k, 600 + k, 5000)} {text}" for k in range(1, 9)])
    assert m <= n + 8 * 3 and once.max() <= many.max() <= once.max() + 8
    assert (many[once > 0] - once[once > 0] > 0).mean() < 0.3
    same, k = counted(["la " * 5000])
    assert k <= 2 and same.sum() <= 2


def test_row_sums_equal_plain_sums():
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(50, 7))
    counts = np.r_[1, 5000, rng.integers(1, 70, 3000), leaks.RUN, leaks.RUN + 1]
    at = rng.integers(0, 50, counts.sum())
    want = np.array([matrix[x].sum(axis=0) for x in np.split(at, np.cumsum(counts)[:-1])])
    assert np.allclose(leaks.row_sums(matrix, at, counts), want)
    assert leaks.row_sums(matrix, at[:0], counts[:0]).shape == (0, 7)


def test_lengths_of_many_windows_equal_the_lengths_of_each():
    rng = np.random.default_rng(5)
    for size in (1, 5, 63, 64, 65, 130):
        text = rng.integers(0, 9, size)
        windows = rng.integers(0, 12, (40, size + 16))
        windows[0, :size] = text
        bits = np.zeros((12, -(-size // 64)), np.uint64)
        for place, w in enumerate(text):
            bits[w, place // 64] |= np.uint64(1) << np.uint64(place % 64)
        assert leaks.common_lengths(bits[windows]).tolist() == leaks.subsequence_length(text, list(windows)).tolist()


def test_windows_are_compared_together_and_not_one_by_one(words, monkeypatch):
    # Half of the rows hold an item, which are of several widths, and one of more than 64 words.
    items = [words(20 + 15 * i, 40 + i, 300) for i in range(6)]
    texts = [f"{words(i % 11, i, 300)} {items[i % 6] if i % 2 else ''} {words(70, 99 + i, 300)}" for i in range(60)]
    rows, = leaks.as_words([pa.record_batch([pa.array(range(60)), pa.array(texts)], ["row", "text"])])
    weights = np.ones(leaks.TERMS, np.float32)
    used = np.unique(np.concatenate([leaks.terms_of(w) for w in leaks.split_words(items)]))
    column = np.full(leaks.TERMS, -1, np.int32)
    column[used] = np.arange(len(used))
    latent = leaks.Latent(weights, column, np.eye(len(used), dtype=np.float32))
    answers = [i.split()[-1] for i in items]
    searched = leaks.Items(list(range(6)), items, answers, latent)
    calls, plain = [], leaks.subsequence_length
    monkeypatch.setattr(leaks, "subsequence_length", lambda *a: calls.append(1) or plain(*a))
    found = [tuple(c[k].as_py() for c in b.columns) for b in leaks.search(searched, latent, 0.2, 0.6, 0.45)([rows]) for k in range(b.num_rows)]
    assert {(r, i) for r, i, _, shared, _ in found if shared == 1.0} == {(i, i % 6) for i in range(60) if i % 2}
    assert not calls
    # Every row and item counts that shares enough in some window, by the plain comparison of each.
    for r, i, _, shared, answer in found:
        own, whole = leaks.split_words([texts[r], items[i]])
        width = -(-len(whole) // leaks.STEP)
        windows = [own[max(0, b - leaks.STEP): b + (width + 1) * leaks.STEP] for b in range(0, len(own), leaks.STEP)]
        assert round(shared * len(whole)) in plain(whole, windows) and (shared >= 0.6 or answer)
