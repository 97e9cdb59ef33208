from __future__ import annotations

import random

from fleetlens.llm import quality, toxicity

INSULTS = {"en": ["grotbag", "numpty", "wazzock"], "de": ["flegelix", "flegelor"]}


def corpus(words, n, seed=1):
    rng, texts, langs, toxic = random.Random(seed), [], {}, []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        w = words(rng.randint(5, 120), seed * 10_000 + i).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS[lang]))
        texts.append(" ".join(w))
        langs[i] = lang
        toxic.append(int(bad))
    return texts, langs, toxic


def test_toxicity_on_held_out_rows(spark, docs_of, words):
    texts, langs, toxic = corpus(words, 900)
    docs = docs_of(texts, langs)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i % 5] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.with_toxicity(docs, model).collect()}
    held = range(0, 900, 5)
    assert sum(rows[i]["toxic"] == bool(toxic[i]) for i in held) >= 0.97 * len(held)
    assert set(model.thresholds) == {"en", "de"}
    assert all(0 <= r["toxicity"] <= 1 for r in rows.values())
    again = toxicity.fit_toxicity(docs.repartition(5), labels)
    assert (again.table == model.table).all() and again.scale == model.scale


def test_toxicity_reads_whole_texts_and_odd_rows(spark, docs_of, words):
    texts, langs, toxic = corpus(words, 400)
    docs = docs_of(texts, langs)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int"))
    long = words(60_000, 7)
    odd = docs_of([None, "", " . ", long, long + " wazzock", "a", "a"]).selectExpr("CAST(NULL AS STRING) AS lang", "doc_id", "text", "1 AS toxicity")
    rows = {r["doc_id"]: r for r in toxicity.with_toxicity(odd, model).collect()}
    assert rows[0]["toxicity"] == rows[1]["toxicity"] == rows[2]["toxicity"] < 0.3
    assert rows[3]["toxicity"] < rows[4]["toxicity"] and rows[4]["toxic"]
    assert rows[5]["toxicity"] == rows[6]["toxicity"]
    assert toxicity.with_toxicity(odd.limit(0), model).count() == 0


def test_toxicity_without_both_labels(spark, docs_of, words):
    docs = docs_of([words(10, 1)])
    empty = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    only = toxicity.fit_toxicity(docs, spark.createDataFrame([(0, 0)], "doc_id bigint, toxic int"))
    scores = [toxicity.with_toxicity(docs, m).first()["toxicity"] for m in (empty, only)]
    assert abs(scores[0] - 0.5) < 1e-6 and abs(scores[1] - 1 / 3) < 1e-6


def junk_or_not(words, n):
    rng, texts, sources, good = random.Random(4), [], {}, []
    for i in range(n):
        ok = i % 3 > 0
        w = words(rng.randint(30, 150), 50_000 + i).split()
        text = " ".join(w) if ok else " ".join(rng.choice(["!!", "$$$", "BUY"]) + x.upper() for x in w[:10] * 8)
        texts.append(text)
        sources[i] = "books" if ok and rng.random() < 0.8 else "spam"
        good.append(int(ok))
    return texts, sources, good


def test_co_training_teaches_both_views(spark, docs_of, words):
    texts, sources, good = junk_or_not(words, 900)
    docs = docs_of(texts, sources=sources)
    labels = spark.createDataFrame([(i, good[i]) for i in range(0, 900, 4)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels)
    assert model.exchanged and all(sum(x.values()) > 0 for x in model.exchanged[:1])
    rows = {r["doc_id"]: r for r in quality.with_quality(docs, model).collect()}
    unseen = [i for i in range(900) if i % 4]
    assert sum((rows[i]["score"] >= 0.5) == bool(good[i]) for i in unseen) >= 0.97 * len(unseen)
    assert all(0 <= rows[i][c] <= 1 for i in unseen for c in ("score", "text_score", "meta_score"))


def test_quality_of_odd_rows_and_without_labels(spark, docs_of, words):
    texts, sources, good = junk_or_not(words, 200)
    docs = docs_of(texts, sources=sources)
    model = quality.fit_quality(docs, spark.createDataFrame(list(enumerate(good)), "doc_id bigint, quality int"))
    odd = docs_of([None, "", "\n\n", words(40_000, 1), "x", "x"]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS source", "'q' AS score")
    rows = {r["doc_id"]: r for r in quality.with_quality(odd, model).collect()}
    assert rows[0]["score"] == rows[1]["score"] and rows[4]["score"] == rows[5]["score"]
    assert quality.with_quality(odd.limit(0), model).count() == 0
    share = quality.fit_quality(docs, spark.createDataFrame([(0, 1)], "doc_id bigint, quality int"))
    assert share == 1.0 and quality.with_quality(docs, share).first()["score"] == 1.0
    assert quality.fit_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == 0.5
