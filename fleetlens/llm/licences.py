"""Licence texts and notices in files, by a positional index of the templates' words.

The words of the templates are counted over all files.  In a file, each template's rarest words that occur are looked up in its
postings; places that agree on where the template would begin are candidates, and a candidate is a find if the template's key
phrases stand where they must and most of its weight is in place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.alignment import ranges
from fleetlens.llm.arrays import IS_MARK, Spans, text_buffers, word_spans

#: Rarest words of a template that are looked up in a file, and the share of them that must agree on its beginning.
RAREST = 12
AGREE = 0.5
#: Share of a template's weight that must be in place.
IN_PLACE = 0.6


@dataclass(frozen=True)
class Template:
    """A licence's text or notice, and phrases of it without which a file does not have it."""

    label: str
    text: str
    keys: tuple[str, ...]


#: The three phrases that always count, wherever they stand.
BASE = (Template("mit", "mit license", ("mit license",)), Template("apache", "apache license", ("apache license",)),
        Template("gpl", "general public license", ("general public license",)))

#: Passages of public licences and of the notices that their publishers ask for.
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
             "files the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
             "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
             "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
             "substantial portions of the software", ("obtaining a copy of this software", "without restriction", "included in all copies")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
             "that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "appear in all copies")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following "
             "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
             "disclaimer in the documentation and or other materials provided with the distribution",
             ("in source and binary forms", "must reproduce the above copyright notice")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
             "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
             "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
             ("except in compliance with the license", "unless required by applicable law")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
             "published by the free software foundation either version 3 of the license or at your option any later version",
             ("the gnu general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
             "license as published by the free software foundation either version 3 of the license or at your option any later version",
             ("lesser general public license", "free software foundation")),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
             "license as published by the free software foundation either version 3 of the license or at your option any later version",
             ("affero general public license", "free software foundation")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
             "with this file you can obtain one at", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
             ("eclipse public license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
             "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
             "commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
             "documentation covered by this license", ("any person or organization obtaining",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
             "compile sell or distribute this software", ("released into the public domain",)),
)
#: The conditions and versions of a family of licences named by initials.
CC_CONDITIONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")


def cc_notices() -> tuple[Template, ...]:
    """The one-line notices of that family: its name, conditions and version in one phrase."""
    return tuple(Template("cc-" + c.replace(" ", "-"), f"licensed under cc {c} {v}", (f"cc {c} {v}",)) for c in CC_CONDITIONS for v in CC_VERSIONS)


TEMPLATES = BASE + PASSAGES + cc_notices()
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


class Index:
    """The templates' words, numbered, with their postings."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        numbers: dict[str, int] = {}
        number = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in WORDS.findall(text.lower())], np.int64)
        self.words = [number(t.text) for t in templates]
        self.keys = [[number(k) for k in t.keys] for t in templates]
        for t, text, keys in zip(templates, self.words, self.keys):
            if not len(text) or any(not len(places(text, k)) for k in keys):
                raise ValueError(f"a key phrase of the template {t.label!r} is not in its text")
        #: Where each key phrase first stands in its template.
        self.key_places = [[int(places(text, k)[0]) for k in keys] for text, keys in zip(self.words, self.keys)]
        entries = [w.encode() for w in numbers]
        self.size = len(entries)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = Spans(self.data)(self.starts, self.starts + self.lengths)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        #: (word, template) pairs in order, with the template's places of the word.
        flat = np.concatenate([w * len(templates) + t for t, w in enumerate(self.words)])
        at = np.concatenate([np.arange(len(w)) for w in self.words])
        order = np.argsort(flat, kind="stable")
        self.pairs, self.pair_first, self.pair_count = np.unique(flat[order], return_index=True, return_counts=True)
        self.pair_places = at[order]
        self.word_first = np.searchsorted(self.pairs, np.arange(self.size + 1) * len(templates))
        #: How far places may differ: half a template's words, 4 at least and 32 at most.
        self.widths = np.array([min(32, max(4, len(w) // 2)) for w in self.words])
        different = np.array([len(np.unique(w)) for w in self.words])
        #: Whether a (word, template) pair's word is in a key phrase, and how many different such words a template has.
        self.pair_key = np.array([p // len(templates) in set(np.concatenate(self.keys[p % len(templates)]).tolist()) for p in self.pairs])
        self.key_words = np.bincount(self.pairs[self.pair_key] % len(templates), minlength=len(templates))
        self.needed = np.maximum(np.minimum(2, different), np.ceil(AGREE * np.minimum(RAREST, different)).astype(np.int64))

    def known(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        out = np.full(len(start), -1, np.int64)
        if len(start):
            hashes = Spans(buf)(start, end)
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            word = self.order[at[hit]]
            # Equal hashes are held against the bytes.
            even = end[hit] - start[hit] == self.lengths[word]
            hit, word = hit[even], word[even]
            wrong = buf[ranges(start[hit], self.lengths[word])] != self.data[ranges(self.starts[word], self.lengths[word])]
            bad = np.unique(np.repeat(np.arange(len(hit)), self.lengths[word])[wrong])
            out[hit] = word
            out[hit[bad]] = -1
        return out


def places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = words[:n] == phrase[0]
    for k in range(1, len(phrase)):
        fits &= words[k: n + k] == phrase[k]
    return np.flatnonzero(fits)


def candidates(index: Index, rank: np.ndarray, word: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, template, first word of a window of beginnings) where enough of a template's rarest words agree."""
    hit = np.flatnonzero(word >= 0)
    if not len(hit):
        return
    count = len(index.templates)
    key, back = np.unique(row[hit] * index.size + word[hit], return_inverse=True)
    by_key = np.argsort(back, kind="stable")
    key_count = np.bincount(back, minlength=len(key))
    key_first = np.cumsum(key_count) - key_count
    # Each different word of a row meets the templates that have it; of a row and template, the rarest words stay.
    pair_count = np.diff(index.word_first)[key % index.size]
    owner = np.repeat(np.arange(len(key)), pair_count)
    pair = ranges(index.word_first[key % index.size], pair_count)
    together = (key // index.size)[owner] * count + index.pairs[pair] % count
    order = np.lexsort((rank[(key % index.size)[owner]], together))
    owner, pair, together = owner[order], pair[order], together[order]
    first = np.flatnonzero(np.append(True, together[1:] != together[:-1]))
    sizes = np.diff(np.append(first, len(together)))
    nth = np.arange(len(together)) - np.repeat(first, sizes)
    # A row without some word of a template's key phrases can't have it.
    keyed = np.add.reduceat(index.pair_key[pair].astype(np.int64), first) == index.key_words[together[first] % count]
    enough = np.repeat((sizes >= index.needed[together[first] % count]) & keyed, sizes)
    seeds = np.flatnonzero((nth < RAREST) & enough)
    if not len(seeds):
        return
    owner, pair, together, nth = owner[seeds], pair[seeds], together[seeds], nth[seeds]
    # A seed's places in the row against its places in the template: each pair votes for a beginning.
    votes = key_count[owner] * index.pair_count[pair]
    k = ranges(np.zeros(len(votes), np.int64), votes)
    owner, pair, together, nth = (np.repeat(x, votes) for x in (owner, pair, together, nth))
    place = at[hit[by_key[key_first[owner] + k // index.pair_count[pair]]]]
    begin = place - index.pair_places[index.pair_first[pair] + k % index.pair_count[pair]]
    groups, group = np.unique(together, return_inverse=True)
    width = index.widths[together % count]
    found = set()
    for shift in (0, 1):
        # Windows overlap by half, so what lies within half a width shares one.
        window = (begin + shift * (width // 2)) // width
        least, most = int(window.min()), int(window.max()) + 1
        # Group, window and seed in one number: different seeds of a window are counted.
        votes_of = np.unique((group * (most - least) + window - least) * RAREST + nth) // RAREST
        place_of, agree = np.unique(votes_of, return_counts=True)
        t = groups[place_of // (most - least)]
        w = place_of % (most - least) + least
        for t, w in zip(t[(some := agree >= index.needed[t % count])].tolist(), w[some].tolist()):
            own = int(index.widths[t % count])
            found.add((t // count, t % count, w * own - shift * (own // 2)))
    yield from sorted(found)


def verified(index: Index, weight: np.ndarray, words: np.ndarray, template: int, begin: int) -> tuple[int, int, float] | None:
    """(first word, last word + 1, share of the weight in place) of a template that begins in the window, if its keys are there."""
    width = int(index.widths[template])
    low, high = begin - width, begin + 2 * width
    for phrase, at in zip(index.keys[template], index.key_places[template]):
        if not len(places(words[max(0, low + at): max(0, high + at + len(phrase))], phrase)):
            return None
    own = index.words[template]
    here = np.full(len(own), -1, np.int64)
    for d in range(begin, begin + width):
        lo, hi = max(0, -d), min(len(own), len(words) - d)
        if lo < hi:
            fits = lo + np.flatnonzero(words[lo + d: hi + d] == own[lo:hi])
            fits = fits[here[fits] < 0]
            here[fits] = fits + d
    share = float(weight[own[here >= 0]].sum() / weight[own].sum())
    if share < IN_PLACE:
        return None
    return int(here[here >= 0].min()), int(here.max()) + 1, min(1.0, share)


def scan_buffer(index: Index, rank: np.ndarray, weight: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Words per row, base places (label, start) per row and finds (label, start, end, share) per row."""
    buf = lower_ascii(buf)
    start, end, first = word_spans(buf, offsets, IS_MARK)
    word = index.known(buf, start, end)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(word)) - np.repeat(first[:-1], counts)
    base: list[list] = [[] for _ in counts]
    for phrase in BASE:
        wanted = [index.words[k] for k, t in enumerate(index.templates) if t == phrase][0]
        for p in places(word, wanted):
            if row[p] == row[p + len(wanted) - 1]:
                base[row[p]].append((phrase.label, int(at[p])))
    best: dict[tuple[int, int], list] = {}
    for r, t, begin in candidates(index, rank, word, row, at):
        find = verified(index, weight, word[first[r]: first[r + 1]], t, begin)
        if find:
            best.setdefault((r, t), []).append(find)
    finds: list[list] = [[] for _ in counts]
    for (r, t), some in best.items():
        # Overlapping windows find a place twice; the fullest stays.
        taken_to = -1
        for s, e, share in sorted(some, key=lambda x: (x[0], -x[2])):
            if s >= taken_to:
                finds[r].append((index.templates[t].label, s, e, share))
                taken_to = e
            elif share > finds[r][-1][3]:
                finds[r][-1] = (index.templates[t].label, s, e, share)
                taken_to = max(taken_to, e)
    return counts, base, [sorted(f, key=lambda x: (x[1], x[0])) for f in finds]


def word_weights(docs: DataFrame, index: Index, text: str) -> np.ndarray:
    """Inverse document frequency of the templates' words over all rows; as many numbers as the templates have words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(index.size + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, buf, offsets in text_buffers(batch.column(0)):
                buf = lower_ascii(buf)
                start, end, first = word_spans(buf, offsets, IS_MARK)
                word = index.known(buf, start, end)
                hit = np.flatnonzero(word >= 0)
                row = np.searchsorted(first, hit, "right") - 1
                held[: index.size] += np.bincount(np.unique(row * index.size + word[hit]) % index.size, minlength=index.size)
        held[index.size] = rows
        yield pa.record_batch([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], ["word", "held"])

    # Never more rows than the templates have words, and one for the number of files.
    totals = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word bigint, held bigint").groupBy("word").agg(F.sum("held"))
    held = np.zeros(index.size + 1)
    for word, n in totals.collect():
        held[word] = n
    return np.log((held[-1] + 1) / (held[:-1] + 0.5)) + math.log(2)


FINDS = ("n_words bigint, base array<struct<label:string,start:bigint>>, "
         "finds array<struct<label:string,start:bigint,end:bigint,share:double>>")


def scan_licences(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = PASSAGES + cc_notices()) -> DataFrame:
    """Per row the id column, n_words, base (places of the three fixed phrases) and finds (templates in place, with their share).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z as a-z; places count from 0, ``end`` is
    behind the last word.  The base phrases are templates too, with a share of 1.  A find holds at least 0.6 of its template's
    weight (words by inverse document frequency over all rows) within a window of half the template's length, 32 words at most,
    and all its key phrases.  Null is the empty text; rows without words have no places.  Rows of equal ids or texts are rows of
    their own.  Texts of any length are looked at whole; other columns are ignored; an empty table gives an empty result.
    """
    index = Index(BASE + tuple(t for t in templates if t not in BASE))
    weight = word_weights(docs, index, text)
    rank = np.argsort(np.lexsort((np.arange(index.size), -weight)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_buffers(batch.column(1)):
                counts, base, finds = scan_buffer(index, rank, weight, buf, offsets)
                yield pa.record_batch([
                    batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                    pa.array([[{"label": a, "start": s} for a, s in b] for b in base], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                    pa.array([[{"label": a, "start": s, "end": e, "share": x} for a, s, e, x in f] for f in finds],
                             pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])))],
                    ["id", "n_words", "base", "finds"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *T._parse_datatype_string(FINDS).fields])
    return docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)
