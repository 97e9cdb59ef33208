from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import chunks


def ends_of(data: bytes) -> list[int]:
    """Chunk ends byte by byte, as a gear hash rolls."""
    h, hashes = 0, []
    for byte in data:
        h = ((h << 1) + int(chunks.GEAR[byte])) & 0xFFFF
        hashes.append(h)
    blank = [i + 1 for i, byte in enumerate(data) if byte in b" \t\n\v\f\r" and hashes[i] < chunks.BOUND or i + 1 == len(data)]
    ends, start = [], 0
    for end in blank:
        inner = [end]
        if end - start > chunks.UNSPACED:
            inner = [i + 1 for i in range(start, end - 1) if hashes[i] < chunks.INNER_BOUND and data[i + 1] & 0xC0 != 0x80
                     and not (i and hashes[i - 1] < chunks.INNER_BOUND)] + [end]
        for stop in inner:
            # A long chunk goes on in steps from its own beginning.
            at = start
            while stop - at > chunks.LONGEST:
                at += chunks.LONGEST
                cut = at
                while data[cut] & 0xC0 == 0x80:
                    cut += 1
                if cut < stop:
                    ends.append(cut)
            ends.append(stop)
            start = stop
    return ends


def words_of(run: bytes, data: bytes, at: int) -> int:
    """Words that begin in the run; of words over 48 bytes, the bytes in the run by six."""
    n, stretch = 0, 0
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", data):
        if len(m[0]) <= chunks.LONG_WORD:
            n += at <= m.start() < at + len(run)
        else:
            stretch += max(0, min(m.end(), at + len(run)) - max(m.start(), at))
    return n + stretch // chunks.WORD_BYTES


def cut_by_hand(texts: list, least_words: int = 24):
    """Texts without runs of chunks that came before, in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        kept, run, start, spans, removed = b"", b"", 0, 0, 0

        def close(run, kept, end=None):
            long = words_of(run, data, (start if end is None else end) - len(run)) >= least_words
            return (kept, len(run), 1) if run and long else (kept + run, 0, 0)

        for end in ends_of(data):
            chunk = data[start:end]
            if chunk in seen:
                run, start = run + chunk, end
            else:
                kept, n, s = close(run, kept)
                start = end
                removed, spans, run = removed + n, spans + s, b""
                kept += chunk
                seen.add(chunk)
        kept, n, s = close(run, kept)
        out.append((kept.decode(), removed + n, spans + s))
    return out


def test_equals_the_rolling_hash_by_hand(docs_of, words, stored):
    shared = words(70, 5)
    texts = [words(120, 1) + " " + shared + " " + words(50, 2), words(30, 3) + "\n" + shared, shared + " ünd " + words(20, 4),
             words(40, 6), words(40, 6), "", None, " ", "x" * 9000, "x" * 9000, "é" * 5000, words(10, 5) + " " + words(10, 5)]
    docs = stored(docs_of(texts))
    rows = {r["doc_id"]: (r["text"], r["n_removed"], r["n_spans"]) for r in chunks.remove_repeats(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == cut_by_hand(texts)


def test_shared_passage_stays_once_and_insertions_do_not_hide_it(docs_of, words, stored):
    shared = words(60, 9)
    texts = [f"{words(40, i)} {'z ' * i}{shared} {words(40, 100 + i)}" for i in range(8)]
    rows = {r["doc_id"]: r for r in chunks.remove_repeats(stored(docs_of(texts))).collect()}
    assert rows[0]["text"] == texts[0]
    assert all(rows[i]["n_removed"] > 0.5 * len(shared) and shared not in rows[i]["text"] for i in range(1, 8))
    assert all(words(40, 100 + i)[80:] in rows[i]["text"] for i in range(8))


def test_short_repeats_stay(docs_of, words, stored):
    line = words(15, 1)
    texts = [f"{words(50, i)}\n{line}\n{words(50, 50 + i)}" for i in range(2, 7)]
    assert all(r["n_removed"] == 0 for r in chunks.remove_repeats(stored(docs_of(texts))).collect())


def test_repeated_rows_null_keys_clashing_columns_and_empty_tables(docs_of, words, stored):
    docs = docs_of([words(80, 1)] * 3).select(
        F.when(F.col("doc_id") > 0, F.col("doc_id")).alias("doc_id"), "text", F.col("lang").alias("row"), F.col("source").alias("idxs"),
        F.array("n_chars").alias("row_id"))
    rows = chunks.remove_repeats(stored(docs)).collect()
    # The null key comes last, so it is cut.
    assert {r["doc_id"]: bool(r["text"]) for r in rows} == {1: True, 2: False, None: False}
    assert {r["row"] for r in rows} == {"en"} and isinstance(rows[0]["row_id"], list)
    assert chunks.remove_repeats(stored(docs.limit(0), "e")).count() == 0


def unspaced(n, seed):
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))


def test_unspaced_text_is_cut_by_content(docs_of, stored):
    """A passage without blanks behind beginnings of any length, and one of 60 words' size."""
    shared, short = unspaced(1500, 1), unspaced(120, 2)
    texts = [unspaced(40 + 13 * i, 10 + i) + shared + unspaced(200, 30 + i) for i in range(4)]
    texts += [unspaced(300, 50 + i) + short + unspaced(300, 60 + i) for i in range(6)]
    docs = stored(docs_of(texts))
    rows = {r["doc_id"]: (r["text"], r["n_removed"], r["n_spans"]) for r in chunks.remove_repeats(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == cut_by_hand(texts)
    assert rows[0][1] == 0 and all(rows[i][1] > 3 * 1300 for i in (1, 2, 3))
    assert sum(rows[i][1] > 0 for i in range(5, 10)) >= 4


def test_long_equal_digests_need_equal_bytes():
    """Two texts that any sum of powers modulo 2^64 confuses."""
    order = [bin(i).count("1") % 2 for i in range(1 << 11)]
    a = np.array([97 + x for x in order] + [98 - x for x in order], np.uint8)
    found = chunks.digests(a, np.array([0, 2048]), np.array([2048, 4096]))
    assert found[0] != found[1]


def test_text_keys(spark, words, stored):
    shared = words(90, 4)
    rows = [("b", shared), ("a", shared), (None, shared), ("c", words(60, 9))]
    got = {r.doc_id: r.n_removed for r in chunks.remove_repeats(stored(spark.createDataFrame(rows, "doc_id string, text string"))).collect()}
    assert got["c"] == 0 and got[None] > 0 and (got["a"] > 0) + (got["b"] > 0) == 1
