from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import rollups

VERSIONS = {n: f"{rollups.TOKENIZER_FOLDER}/{n}.tiktoken" for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
CHANGE = "op string, source string, lang string, before string, after string, signed int"


def totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}


def counted(rows):
    docs, tokens = Counter(), Counter()
    for source, lang, text in rows:
        for version, path in VERSIONS.items():
            docs[source, lang, version] += 1
            tokens[source, lang, version] += len(rollups.encoding(path).encode_ordinary(text or ""))
    return {k: (docs[k], tokens[k]) for k in docs}


def test_totals_follow_inserts_deletes_and_revisions(spark, words, tmp_path):
    store = rollups.TokenTotals(spark, str(tmp_path / "totals"))
    assert totals(store) == {}
    live = [("a", "en", words(40, i)) for i in range(9)] + [("b", None, "é𝄞 x"), (None, "de", None), ("b", "en", "")]
    first = spark.createDataFrame([("insert", s, g, None, t, 1) for s, g, t in live], CHANGE)
    assert store.commit("1", rollups.deltas_of(first, VERSIONS))
    assert totals(store) == counted(live)
    second = spark.createDataFrame(
        [("delete", *live[0][:2], live[0][2], None, 1), ("revise", *live[1][:2], live[1][2], "new text", 1),
         ("delete", *live[10][:2], None, None, 1), (None, "a", "en", "x", "y", 1), ("other", "a", "en", "x", "y", 1)], CHANGE)
    assert store.commit("2", rollups.deltas_of(second, VERSIONS))
    now = [*live[2:10], live[11], ("a", "en", "new text")]
    assert totals(store) == counted(now)
    # The same batch again, from another writer of the same folder, changes nothing.
    assert not rollups.TokenTotals(spark, str(tmp_path / "totals")).commit("2", rollups.deltas_of(second, VERSIONS))
    assert totals(store) == counted(now) and store.batches() == ["1", "2"]


def test_interrupted_attempts_and_empty_batches(spark, tmp_path):
    store = rollups.TokenTotals(spark, str(tmp_path / "totals"))
    some = spark.createDataFrame([("insert", "a", "en", None, "one two", 1)], CHANGE)
    rollups.deltas_of(some, VERSIONS).write.parquet(str(tmp_path / "totals/attempts/1-left"))
    assert store.commit("0", rollups.deltas_of(some.limit(0), VERSIONS)) and totals(store) == {}
    with pytest.raises(ValueError):
        store.commit("a/b", rollups.deltas_of(some, VERSIONS))


def test_moving_between_sources(spark, tmp_path):
    store = rollups.TokenTotals(spark, str(tmp_path / "totals"))
    move = spark.createDataFrame([("revise", "new", "en", "old", "one", "two words")], "op string, source string, lang string, was string, before string, after string")
    store.commit("1", rollups.deltas_of(move, VERSIONS, old_source="was"))
    assert {(s, d) for (s, _, _), (d, _) in totals(store).items()} == {("new", 1), ("old", -1)}


def test_counts_move_as_texts_do(spark, words, tmp_path):
    rows = [("insert", "a", "en", None, words(30, 1)), ("revise", "a", "en", words(9, 2), words(7, 3)), ("delete", None, "de", "x y", None),
            ("insert", "b", "en", None, None), (None, "b", "en", "x", "y")]
    texts = spark.createDataFrame([(*r, 1) for r in rows], CHANGE)
    by_texts = rollups.TokenTotals(spark, str(tmp_path / "texts"))
    by_counts = rollups.TokenTotals(spark, str(tmp_path / "counts"))
    by_texts.commit("1", rollups.deltas_of(texts, VERSIONS))
    for version, path in VERSIONS.items():
        count = rollups.token_count(path)
        by_counts.commit(version, rollups.deltas_of_counts(texts.select(
            "op", "source", "lang", F.lit(version).alias("tokenizer"), count("before").alias("before"), count("after").alias("after"))))
    assert totals(by_texts) == totals(by_counts)


def test_query_equals_counting_what_is_left(spark, docs_of, words, tmp_path):
    from fleetlens.llm.queries import QUERIES

    texts = [words(20 + i, i) + (" 12 x9" if i % 2 else "") for i in range(20)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 3 == 0)) for i in range(16)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    left = [(f"s{i % 3}", "en", re.sub("[0-9]", "", t) if i < 16 and i % 3 == 0 else t) for i, t in enumerate(texts) if i >= 16 or i % 5]
    want = {(s, g, v + "@1"): n for (s, g, v), n in counted(left).items()}
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"])
            for r in QUERIES["op5_token_totals"](spark, str(tmp_path)).collect()} == want


def test_repeated_labels_change_a_document_once(spark, docs_of, words, tmp_path):
    from fleetlens.llm.queries import QUERIES

    texts = [words(25, i) + " 7" for i in range(6)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    # Low quality twice; low quality and toxic in two rows; toxic twice; no document; nulls.
    labels = [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 0, None), (2, 1, 1), (2, 1, 1), (99, 0, 0), (None, 0, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = counted([(f"s{i % 3}", "en", re.sub("[0-9]", "", t) if i == 2 else t) for i, t in enumerate(texts) if i > 1])
    assert {(r["source"], r["lang"], r["tokenizer"].removesuffix("@1")): (r["docs"], r["tokens"])
            for r in QUERIES["op5_token_totals"](spark, str(tmp_path)).collect()} == want


def test_second_writer_of_a_batch_loses(spark, tmp_path):
    """Both have written their attempt; the marker decides, and the loser's folder goes."""
    some = spark.createDataFrame([("insert", "a", "en", None, "one two", 1)], CHANGE)
    store, other = (rollups.TokenTotals(spark, str(tmp_path / "totals")) for _ in range(2))
    real = other._files

    class Late:
        """A file system that sees the marker only when it is too late."""
        def __init__(self, files):
            self.files, self.asked = files, 0

        def exists(self, path):
            self.asked += 1
            return self.asked > 1 and self.files.exists(path)

        def __getattr__(self, name):
            return getattr(self.files, name)

    late: dict = {}

    def slow(text):
        path, files = real(text)
        return path, late.setdefault("files", Late(files)) if text.endswith("batch=1") else files

    other._files = slow
    assert store.commit("1", rollups.deltas_of(some, VERSIONS))
    assert not other.commit("1", rollups.deltas_of(some.union(some), VERSIONS))
    assert {d for d, _ in totals(store).values()} == {1} and len(list((tmp_path / "totals/attempts").iterdir())) == 1
