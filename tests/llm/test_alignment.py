"""Token alignment against whole texts encoded one by one and compared token by token."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import alignment
from fleetlens.llm.rollups import TOKENIZER_FOLDER

FILES = f"{TOKENIZER_FOLDER}/byte_bpe_50k.json", f"{TOKENIZER_FOLDER}/piece_bpe_32k.model"
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b   c\td\n\ne ", "the ▁ mark", "▁", "<|endoftext|> and <s> are text", "no  break  wide  x",
    "漢字かな混じり文、そのまま続く。" * 20, "😀😀 ok 👩‍👩‍👧", "don't can't we'll I'd", "x" * 3000, " " * 500 + "end", "\x00\x01 control\x7f chars",
    "1234567890 12 345", "ﬁ ① Ａ", "é combining", "　start", "a\u0085 b   c", "<0x41> literal", "the the the the", "the the the the",
]


@pytest.fixture(scope="module")
def sides():
    out = []
    for kind, path in zip((alignment.ByteLevel, alignment.Pieces), FILES):
        with open(path, "rb") as file:
            out.append(alignment.loaded(kind, file.read()))
    return out


def brute(texts, sides):
    first, second = sides
    rows, held = [], Counter()
    for text in texts:
        a_ids = b_ids = []
        if text:
            a_ids = first.model.encode(" " + text, add_special_tokens=False).ids
            b_ids = second.model.encode(text)
            want = (" " + text).encode()
            if any(t.vocabulary.bytes_of(np.array(i, np.int64)).tobytes() != want for t, i in ((first, a_ids), (second, b_ids))):
                a_ids = b_ids = []
        groups, i, j, x, y = [], 0, 0, 0, 0
        while i < len(a_ids):
            a, b = [a_ids[i]], [b_ids[j]]
            x, y, i, j = int(first.vocabulary.lengths[a[0]]), int(second.vocabulary.lengths[b[0]]), i + 1, j + 1
            while x != y:
                if x < y:
                    a.append(a_ids[i]); x += int(first.vocabulary.lengths[a_ids[i]]); i += 1
                else:
                    b.append(b_ids[j]); y += int(second.vocabulary.lengths[b_ids[j]]); j += 1
            groups.append((a, b))
        links = Counter((p, q) for a, b in groups for p in a for q in b)
        held.update(links.keys())
        digest = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(digest.encode()).hexdigest() if groups else ""))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(a, b, g, sum(k.values()), sum(n for p, n in k.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in k.items()), d)
            for a, b, g, k, d in rows], held


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_same_as_token_by_token(docs_of, words, sides):
    texts = ODD + [words(n, n) for n in (1, 7, 60, 400)] + [words(9000, 3) + " " + "äöü" * 400]
    docs = docs_of(texts)
    # Blocks of any size give the same rows.
    for block in (alignment.BLOCK, 300):
        found = alignment.Alignment(docs, *FILES, block=block)
        rows, held = brute(texts, sides)
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.documents.collect()}
        assert [got[i] for i in range(len(texts))] == rows
        assert {(r.a_id, r.b_id): r.documents for r in found.pairs.collect()} == dict(held)
    assert [i for i, r in enumerate(rows) if not r[0]][:2] == [0, 1] and rows[8][0] == 0, "a text with the mark of the pieces does not come back"


def test_large_group_is_counted_by_its_ids():
    first, second = (alignment.Vocabulary([b"ab", b"a", b"b", b"ba", b"abab"]) for _ in range(2))
    # 'a' + 'ba' * 200 + 'b' against 'ab' * 201: no common end before the last byte.
    a_ids, b_ids = np.array([1] + [3] * 200 + [2]), np.array([0] * 201)
    groups = alignment.Groups(a_ids, np.array([202]), b_ids, np.array([201]), first, second)
    assert groups.per_document.tolist() == [1]
    group, pair, many = groups.links()
    assert dict(zip(pair.tolist(), many.tolist())) == {k * alignment.SIDE: n * 201 for k, n in ((1, 1), (2, 1), (3, 200))}


def test_empty_table_string_ids_and_other_columns(spark):
    kind = "doc_id string, text string, block string, slot int, id int, `n_a` int"
    empty = alignment.Alignment(spark.createDataFrame([], kind), *FILES)
    assert empty.documents.count() == 0 and empty.pairs.count() == 0
    rows = [("x", "some text", "b", 1, 2, 3), (None, "some text", "b", 1, 2, 3), ("z", None, None, None, None, None)]
    out = {r.doc_id: r for r in alignment.Alignment(spark.createDataFrame(rows, kind), *FILES).documents.collect()}
    assert out["x"].n_a == out[None].n_a == 2 and out["x"].count_sum == 2 * out["x"].n_links
    assert tuple(out["z"])[1:] == (0, 0, 0, 0, 0, 0, "")
    only_empty = alignment.Alignment(spark.createDataFrame(rows[2:], kind), *FILES).documents.collect()
    assert [tuple(r)[1:] for r in only_empty] == [(0, 0, 0, 0, 0, 0, "")]


def test_no_stored_row_holds_a_block(docs_of, words, monkeypatch):
    """A row of a whole block made Spark hold as many blocks as a batch or a row group has rows."""
    kept, store = [], alignment.cut_lineage
    monkeypatch.setattr(alignment, "cut_lineage", lambda df, **how: kept.append(store(df, **how)) or kept[-1])
    found = alignment.Alignment(docs_of([words(9000, 3), None, *["äöü" * 1500 + f" {i}" for i in range(3)]]), *FILES)
    lists = [c for c, kind in kept[0].dtypes if kind.startswith("array")]
    longest = kept[0].select([F.max(F.size(c)).alias(c) for c in lists]).first()
    assert lists and all(0 < n <= 1024 for n in longest), longest
    assert found.documents.count() == 5


def test_links_in_slices_are_the_same(words, sides, monkeypatch):
    table = pa.table({"id": [1, 2, 3], "text": [words(500, 1), "", "1234567890 12 345 " * 30 + words(90, 2)]})
    whole = list(alignment.align_block(table, *sides))
    monkeypatch.setattr(alignment, "LINKS", 7)
    monkeypatch.setattr(alignment, "MANY", 5)
    assert list(alignment.align_block(table, *sides)) == whole
