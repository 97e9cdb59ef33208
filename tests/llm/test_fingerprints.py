from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from fleetlens.llm import fingerprints as fp


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_next_text_in_descending_order_over_chunks(docs_of, words):
    texts = [words(3 + i % 9, i) for i in range(97)] + [None, "é𝄞x"]
    docs = docs_of(texts)
    for rows in (7, 10_000):
        got = by_id(fp.with_next_text(docs, "next_text", chunk_rows=rows).withColumn(
            "edited", fp.edited_text("text", "next_text")).collect())
        for i in range(len(texts)):
            following = texts[i - 1] or ""
            assert got[i]["next_text"] == following
            assert got[i]["edited"] == edited(texts[i] or "", following)


def test_sketch_is_every_low_hash(spark, docs_of, words):
    texts = [words(n, n) for n in (0, 1, 4, 5, 6, 40, 400)] + [None, "  \n"]
    rows = by_id(fp.with_sketch(docs_of(texts), "text", "sketch").collect())
    bound = fp.LEAST + int(fp.FRACTION * 2 ** 64)
    for i, text in enumerate(texts):
        w = (text or "").split()
        shingles = [w[k: k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else []
        if shingles:
            frame = spark.createDataFrame([(*s,) for s in shingles], ["a", "b", "c", "d", "e"])
            hashes = {r[0] for r in frame.select(F.xxhash64("a", "b", "c", "d", "e")).collect()}
        elif w:
            hashes = {spark.createDataFrame([(" ".join(w),)], ["a"]).select(F.xxhash64("a")).first()[0]}
        else:
            hashes = set()
        low = {h for h in hashes if h < bound}
        assert rows[i]["sketch"] == sorted(low or ({min(hashes)} if hashes else set()))


def test_likeness_containment_and_merging(docs_of, words):
    long, other = words(4000, 1), words(3000, 2)
    part = " ".join(long.split()[:600])
    docs = docs_of([long, part, other, long + " " + other])
    rows = fp.with_sketch(docs, "text", "a").select("doc_id", "a")
    pairs = rows.crossJoin(rows.selectExpr("doc_id AS other", "a AS b")).withColumn("j", fp.jaccard("a", "b")).withColumn(
        "c", fp.containment("a", "b"))
    got = {(r["doc_id"], r["other"]): r for r in pairs.collect()}
    assert got[0, 0]["j"] == 1 and got[1, 0]["c"] == 1
    assert abs(got[0, 1]["c"] - 0.15) < 0.05 and abs(got[0, 1]["j"] - 0.15) < 0.05
    assert got[0, 2]["j"] < 0.05
    union = rows.filter("doc_id in (0, 2)").agg(F.collect_list("a").alias("s")).select(fp.merged("s").alias("m")).first()["m"]
    whole = rows.filter("doc_id = 3").first()["a"]
    assert len(set(whole) ^ set(union)) <= 4  # the shingles across the joint


def test_empty_tables_repeated_rows_null_keys_and_clashing_columns(docs_of, words):
    docs = docs_of([words(20, 1), words(20, 1), None]).selectExpr("*", "1 AS chunk", "2 AS tie", "3 AS ghost")
    rows = fp.with_sketch(fp.with_next_text(docs, "next_text"), "text", "sketch").collect()
    assert len(rows) == 3 and {r["chunk"] for r in rows} == {1}
    assert rows[0]["sketch"] is not None
    assert fp.with_next_text(docs.limit(0), "next_text").count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert fp.with_next_text(nulls, "next_text").count() == 3


def test_query_digest(spark, docs_of, words, stored, tmp_path):
    from fleetlens.llm.queries import QUERIES

    texts = [words(30, i) for i in range(6)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = by_id(QUERIES["op10_fingerprints"](spark, str(tmp_path)).collect())
    for i, text in enumerate(texts):
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited(text, texts[i - 1]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1
