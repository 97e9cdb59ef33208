"""Licence scans: base phrases against a search by regular expression, templates against every beginning tried in turn."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fleetlens.llm import licences as L

PHRASES = {t.label: t.text.split() for t in L.BASE}
MIT = next(t for t in L.PASSAGES if t.label == "mit").text
BSD = next(t for t in L.PASSAGES if t.label == "bsd").text


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = L.WORDS.findall(lower(text))
    at = sorted((i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i: i + len(p)] == p)
    return len(words), at


def scanned(docs):
    return {r.doc_id: r for r in L.scan_licences(docs).collect()}


def labels(row):
    return {f.label for f in row.finds}


def noise(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["lorem", "ipsum", "the", "of", "license", "mit", "software", "copy", "à", "x1", "notice", "free"]) for _ in range(n)]


ODD = [None, "", "  \n", "MIT License", "mit-license; MIT\tLICENSE", "mitlicense", "mit é license", "mité license", "MIT LİCENSE", "Apache License apache license",
       "gnu General Public License", "general public", "license mit", "mit", "general public license general public license mit license",
       "the mit license" * 3000, " ".join(noise(30_000, 1)), "mit license " * 20_000]


def test_base_places(docs_of):
    texts = ODD + [" ".join(noise(400, s)) for s in range(20)]
    rows = scanned(docs_of(texts))
    for i, text in enumerate(texts):
        n, at = brute_base(text)
        assert (rows[i].n_words, sorted((b.start, b.label) for b in rows[i].base)) == (n, at), text and text[:60]
        assert {label for _, label in at} <= labels(rows[i])
        assert all(0 < f.share <= 1 and 0 <= f.start < f.end <= n for f in rows[i].finds)
    assert rows[3].finds[0].share == 1.0 and not rows[0].finds


def edited(text, seed, share):
    """The text with words exchanged and others put in."""
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else rng.choice(["zzz", w + " qqq"]) for w in text.split())


def test_templates(docs_of):
    before, after = " ".join(f"w{i}" for i in range(5000)), " ".join(f"v{i}" for i in range(800))
    cases = {
        0: (MIT.upper(), {"mit"}), 1: (f"{before} {MIT} {after}", {"mit"}), 2: (f"/* {MIT.replace(' copy ', ' copy, ')} */ {BSD}", {"mit", "bsd"}),
        3: ("Licensed under CC BY-NC 4.0", {"cc-by-nc"}), 4: ("Licensed under CC BY-NC-SA 4.0.", {"cc-by-nc-sa"}),
        # The key phrases are missing, or the words stand elsewhere.
        5: (MIT.replace("without restriction", "with some restriction"), set()), 6: (" ".join(sorted(MIT.split())), set()),
        7: (" ".join(MIT.split()[:30]), set()), 8: (" ".join(x for w in MIT.split() for x in (w, "a", "b", "c", "d")), set()),
        9: (f"{MIT} {after} {MIT}", {"mit"}), 10: (edited(BSD, 3, 0.0), {"bsd"}), 11: (None, set()),
    }
    rows = scanned(docs_of([cases[i][0] for i in range(len(cases))]))
    for i, (_, want) in cases.items():
        assert labels(rows[i]) == want, i
    start = next(f for f in rows[1].finds)
    assert (start.start, start.end) == (5000, 5000 + len(MIT.split())) and start.share == 1.0
    assert [f.start for f in rows[9].finds] == [0, len(MIT.split()) + 800]


def brute_finds(index, weight, words):
    """Labels found when every beginning is verified, without the index."""
    out = set()
    for t in range(len(index.templates)):
        for begin in range(-int(index.widths[t]), len(words) + 1):
            if L.verified(index, weight, words, t, begin):
                out.add(index.templates[t].label)
                break
    return out


def test_index_loses_no_find():
    """Texts with changed words: what the votes bring in is what trying all beginnings finds."""
    index = L.Index(L.TEMPLATES)
    weight = np.ones(index.size)
    rank = np.arange(index.size)
    found = 0
    for seed in range(40):
        template = L.PASSAGES[seed % len(L.PASSAGES)]
        text = " ".join(noise(50, seed)) + " " + edited(template.text, seed, 0.04) + " " + " ".join(noise(50, seed + 1))
        buf = np.frombuffer(text.encode(), np.uint8)
        counts, _, finds = L.scan_buffer(index, rank, weight, buf, np.array([0, len(buf)]))
        start, end, _ = L.word_spans(L.lower_ascii(buf), np.array([0, len(buf)]), L.IS_MARK)
        want = brute_finds(index, weight, index.known(L.lower_ascii(buf), start, end))
        assert {f[0] for f in finds[0]} == want
        found += template.label in want
    assert found >= 20


def test_weights_count_every_row(docs_of):
    index = L.Index(L.TEMPLATES)
    docs = docs_of(["mit license"] * 30 + ["apache"] * 5 + [None, ""])
    weight = L.word_weights(docs, index, "text")
    word = {w: i for i, w in enumerate(dict.fromkeys(w for t in L.TEMPLATES for part in (t.text, *t.keys) for w in part.split()))}
    assert weight[word["mit"]] == pytest.approx(np.log(38 / 30.5) + np.log(2)) and weight[word["apache"]] == pytest.approx(np.log(38 / 5.5) + np.log(2))
    assert (weight > 0).all() and weight.argmin() in (word["mit"], word["license"])


def test_empty_table_and_other_columns(spark):
    kind = "doc_id string, text string, base string, finds int, n_words int, word int"
    assert L.scan_licences(spark.createDataFrame([], kind)).count() == 0
    rows = L.scan_licences(spark.createDataFrame([("a", "MIT License", "b", 1, 2, 3), ("a", "MIT License", "b", 1, 2, 3), (None, None, None, None, None, None)], kind)).collect()
    assert sorted((r.doc_id or "", r.n_words, len(r.base)) for r in rows) == [("", 0, 0), ("a", 2, 1), ("a", 2, 1)]


def test_a_key_phrase_outside_its_text_is_refused():
    with pytest.raises(ValueError):
        L.Index((L.Template("x", "some words", ("other words",)),))
