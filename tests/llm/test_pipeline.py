from __future__ import annotations

import random

import corpus_pipeline


def test_stages_take_what_they_should_and_leave_the_rest(spark, docs_of, words, tmp_path):
    rng = random.Random(5)
    clean = [words(rng.randint(60, 200), 100 + i, 6000) for i in range(120)]
    toxic = [words(80, 400 + i, 6000) + " vileword " + words(20, 500 + i, 6000) for i in range(60)]
    copies = [clean[0]] * 5 + [clean[1] + " end"]
    passage, item = words(80, 900, 6000), words(40, 901, 6000)
    sharing = [f"{words(60, 600 + i, 6000)} {passage} {words(60, 700 + i, 6000)}" for i in range(6)]
    leaking = [f"{words(60, 800 + i, 6000)} {item} {words(60, 850 + i, 6000)}" for i in range(4)]
    texts = clean + toxic + copies + sharing + leaking
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(120 <= i < 180)) for i in range(180) if i % 6]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{name}"))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "source_mix" or docs.columns == columns
    kept = list(seen.values())
    at = {"clean": range(120), "toxic": range(120, 180), "copies": range(180, 186), "sharing": range(186, 192), "leaking": range(192, 196)}
    assert not set(at["toxic"]) & set(kept[0]) and set(range(len(texts))) - set(at["toxic"]) <= set(kept[0])
    assert set(kept[0]) - set(kept[1]) == set(at["copies"])
    assert [passage in kept[2][i]["text"] for i in at["sharing"]] == [True] + [False] * 5
    assert all(kept[2][i]["text"] == texts[i] for i in at["clean"]) and kept[2][187]["n_chars"] == len(kept[2][187]["text"])
    # The passage of an item that several documents share is cut from all but the first, which goes.
    assert set(kept[2]) - set(kept[3]) == {192} and not any(item in r["text"] for r in kept[3].values())
    assert set(kept[4]) <= set(kept[3]) and all(r["taken"] > 0 for r in kept[4].values())
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r["taken"] for i, r in kept[4].items()}


EXTRA = "row_id bigint, toxicity double, n_removed string, taken string, class_id string, `size` int"


def run_stages(spark, docs, labels, items, folder):
    """(doc_id, text) lists that each stage leaves of a table with extra columns."""
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs, columns, left = spark.read.parquet(f"{folder}/documents.parquet"), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{name}")
        docs = spark.read.parquet(f"{folder}/stage-{name}")
        left[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert name == "source_mix" or docs.columns == columns, name
    return left


def with_extra(spark, rows):
    return spark.createDataFrame([(*r, 7, 0.5, "n", "t", "c", 3) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA)


def test_odd_rows_pass_every_stage(spark, words, tmp_path):
    """Nulls in any column, empty and blank texts, a very long text, repeated rows, and columns named as the stages' own."""
    long = words(60_000, 3, 9000)
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "   ", None, "s", 3), (3, long, "en", "s", len(long)),
            (None, words(70, 4, 6000), "en", None, None), (5, words(80, 5, 6000), "en", "s", 1), (5, words(80, 5, 6000), "en", "s", 1),
            *[(10 + i, words(90, 20 + i, 6000), "en", f"s{i % 2}", 1) for i in range(12)], (30, words(60, 50, 6000) + " vileword", "en", "s", 1)]
    labels = [(10 + i, 1, 0) for i in range(12)] + [(30, 0, 1), (5, 1, None), (None, 1, 1), (99, None, 0)]
    left = run_stages(spark, with_extra(spark, rows), labels, [(0, None), (1, ""), (2, words(30, 77, 6000)), (None, "x")], str(tmp_path))
    ids = {name: [d for d, _ in some] for name, some in left.items()}
    assert ids["toxicity"].count(5) == 2 and {3, 10, 21} <= set(ids["toxicity"])
    # Of equal rows one stays; texts without words are no copies of each other's words.
    assert ids["near_copies"].count(5) == 1
    assert dict(left["repeated_passages"])[3] == long and {3, 5, 10, 21} <= set(ids["benchmark_leaks"])
    assert set(ids["source_mix"]) <= set(ids["benchmark_leaks"])


def test_empty_tables(spark, tmp_path):
    left = run_stages(spark, with_extra(spark, []), [], [], str(tmp_path))
    assert all(some == [] for some in left.values())


def test_without_labels_nothing_is_toxic(spark, docs_of, words, tmp_path):
    docs = docs_of([words(40, i) for i in range(8)])
    for k, labels in enumerate(([], [(i, 1, 0) for i in range(8)], [(i, 1, 1) for i in range(8)])):
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / f"{k}/labels.parquet"))
        assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / str(k))).count() == 8
