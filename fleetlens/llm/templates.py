"""Extract the main text of web pages by deducing each host's template from equivalence classes of tokens."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import fresh
from fleetlens.session import cut_lineage

#: Fixed names of HTML: elements without an end tag, elements that end an open paragraph, elements that lie within a line,
#: elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
#: Elements that hold no article text.
ASIDE = frozenset("nav header footer aside form script style noscript template head title iframe svg math object canvas audio "
                  "video button select textarea input dialog menu search".split())
#: Words in class, id, role or label of an element that holds no article text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "disqus footer header masthead menu nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted "
    "promotion recommended related replies respond share sharing sidebar sidebars skip social sponsor sponsored subscribe "
    "toolbar widget widgets alert complementary contentinfo search gdpr paywall signup login".split())
#: With one of these a class tells what a page has beside the element, as in "has-sidebar".
TELLING = frozenset(("has", "with", "without", "no"))
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("articlebody main article".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
MENTIONED = re.compile(r"class|id|role|itemprop|aria-label|hidden|style", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")


@lru_cache(maxsize=1 << 14)
def attributes(text: str) -> tuple[frozenset, bool]:
    """The words in an element's class, id, role and label, and whether it is hidden."""
    if not MENTIONED.search(text):
        return frozenset(), False
    words, hidden = set(), False
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = hidden or value.lower() != "false"
        elif name == "style":
            hidden = hidden or bool(HIDDEN.search(value))
        else:
            words.update(w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w)
            words.add(value.lower())
    return frozenset(words), hidden


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) in page order: open and close tags, and text, with undecoded references.

    Comments, declarations and processing instructions give nothing.  What follows the start of a raw element up to its
    end tag, or the end of the page, is its text alone.
    """
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            # A tag that the page breaks off inside is no text.
            cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", rest)
            yield "text", "", rest[: cut.start()] if cut else rest
            return
        if m.start() > at:
            yield "text", "", page[at: m.start()]
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", "", m[0][9:].removesuffix("]]>").replace("&", "&amp;")
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            yield "raw", name, page[at: end.start() if end else size]
            yield "close", name, ""
            at = end.end() if end else size


NONE: tuple[frozenset, bool] = (frozenset(), False)


class Walk:
    """The open elements while the tokens of a page pass, with the few repairs that browsers make."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[str] = []
        self.info: list[tuple[frozenset, bool]] = []

    def open(self, name: str, text: str) -> None:
        if "p" in self.names and name in BLOCKS and name not in ("html", "body"):
            self.close("p")
        if name == "li" and self.names and self.names[-1] == "li":
            self.close("li")
        words, hidden = attributes(text) if text else NONE
        if words:
            name_and_words = name + "".join(sorted("." + w for w in words if not any(c.isdigit() for c in w)))
        else:
            name_and_words = name
        self.names.append(name)
        self.paths.append(f"{self.paths[-1] if self.paths else ''}/{name_and_words}")
        self.info.append((words, hidden))

    def _last(self, name: str) -> int:
        return len(self.names) - 1 - self.names[::-1].index(name)

    def close(self, name: str) -> list[str]:
        """Closes the last open element of that name and all inside it; their paths, innermost first."""
        if name not in self.names:
            return []
        k = self._last(name)
        gone = self.paths[:k - 1 if k else None:-1] if k else self.paths[::-1]
        del self.names[k:], self.paths[k:], self.info[k:]
        return gone


@lru_cache(maxsize=1 << 14)
def path_id(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def block_id(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(path + "\n" + text) - (1 << 63)


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, html) to (host, token, path, vector, pages, contents): the occurrence vectors of tokens.

    A token is an element by its path of labels, or a block of text by its words and the path it stands in (null ``path``).
    Its vector, the count per page, is summed up as a digest over pages, which adds over tasks: equal digests are equal
    vectors.  ``contents`` has a bit of 64 for each page content, so that copies of one page count as one.
    """
    for batch in batches:
        totals: dict[tuple[str, int], list] = {}
        for page, host, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts: dict[int, list] = {}
            for event in events(text, {}):
                if event[0] == "open":
                    counts.setdefault(path_id(event[1]), [0, event[1]])[0] += 1
                elif event[0] == "block":
                    counts.setdefault(event[1], [0, None])[0] += 1
            bit = 1 << (xxhash.xxh3_64_intdigest(text) & 63)
            for token, (n, path) in counts.items():
                t = totals.setdefault((host, token), [0, 0, path, 0])
                t[0] = (t[0] + xxhash.xxh3_64_intdigest(f"{page}:{n}")) & ((1 << 64) - 1)
                t[1] += 1
                t[3] |= bit
        hosts, found = zip(*totals) if totals else ((), ())
        whole = lambda k: pa.array(np.array([t[k] for t in totals.values()], np.uint64).view(np.int64))
        yield pa.record_batch(
            [pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array([t[2] for t in totals.values()], pa.string()),
             whole(0), pa.array([t[1] for t in totals.values()], pa.int64()), whole(3)],
            ["host", "token", "path", "vector", "pages", "contents"])


def class_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, classes) to (host, class, token, low, high, parent_low, parent_high, text, linked): per token a digest of its
    class's order in the page, a digest of the place the class is nested in, and the text in the token's elements.

    An order is valid where low and high, the smallest and largest digest over all pages, agree; so is a nesting.
    """
    for batch in batches:
        totals: dict[tuple[str, int, int], list] = {}
        for host, text, classes in zip(*(c.to_pylist() for c in batch.columns)):
            member = {c["token"]: c["class"] for c in classes or ()}
            if not member:
                continue
            rounds: dict[int, list[list[int]]] = {}
            parents: dict[int, set] = {}
            places: dict[int, set] = {}
            sizes: dict[int, list[int]] = {}
            stack: list[tuple[int, int]] = []

            def begin(token: int, is_block: bool = False) -> bool:
                own = member.get(token)
                if own is None:
                    return False
                outer = next((s for s in reversed(stack) if s[0] != own), None)
                # A block stands in a slot of its own, whatever else its class has.
                (places.setdefault(token, set()) if is_block else parents.setdefault(own, set())).add(outer)
                lists = rounds.setdefault(own, [[]])
                if token in lists[-1]:
                    lists.append([])
                lists[-1].append(token)
                sizes.setdefault(token, [0, 0])
                return True

            for kind, what, size, linked in events(text, {}):
                if kind == "open":
                    token = path_id(what)
                    if begin(token):
                        stack.append((member[token], token))
                elif kind == "close":
                    if stack and stack[-1][1] == path_id(what):
                        stack.pop()
                elif kind == "text":
                    for around in {t for _, t in stack}:
                        s = sizes[around]
                        s[0] += size
                        s[1] += linked
                elif kind == "block":
                    begin(what, True)
            for own, lists in rounds.items():
                order = {path_id(repr(x)) for x in lists}
                for token in {t for x in lists for t in x}:
                    nest = {path_id(repr(x)) for x in (places.get(token) or parents[own])}
                    t = totals.setdefault((host, own, token), [min(order), max(order), min(nest), max(nest), 0, 0])
                    t[0], t[1], t[2], t[3] = min(t[0], *order), max(t[1], *order), min(t[2], *nest), max(t[3], *nest)
                    t[4] += sizes[token][0]
                    t[5] += sizes[token][1]
        rows = [(*key, *t) for key, t in totals.items()]
        cols = list(zip(*rows)) if rows else [()] * 9
        yield pa.record_batch([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                              ["host", "class", "token", "low", "high", "parent_low", "parent_high", "text", "linked"])


#: Share of its text in links above which an element of the template is a list of links.
MOSTLY_LINKS = 0.6
#: What stands for a block of text that the template itself has, where elements have their link share.
TEMPLATE_TEXT = 2.0


def events(page: str, template: dict[int, float]) -> Iterator[tuple]:
    """What a page consists of, given the link share of each token of its host's template (token id to share):

    ("open", path, 0, 0) and ("close", path, 0, 0) of elements, ("text", path, length, linked length), and
    ("block", token, text, where) when a block of text, as the page writes it, ends; ``where`` is (in the main part, in surroundings).
    """
    walk = Walk()
    inside: list[bool] = []
    aside: list[bool] = []
    now: list[str] = []
    state, where = (False, False), ""

    def ended():
        nonlocal now
        if now:
            text = "".join(now).strip()
            now = []
            if text:
                yield "block", block_id(where, text), text, state

    for kind, name, text in tokens(page):
        if kind == "open":
            if name in BLOCKS or name == "br":
                yield from ended()
            walk.open(name, text)
            yield "open", walk.paths[-1], 0, 0
            del inside[len(walk.names) - 1:], aside[len(walk.names) - 1:]
            words, hidden = walk.info[-1]
            top = not inside
            in_main = (not top and inside[-1]) or name in MAIN or bool(words & MAIN_WORDS and name not in ("body", "html"))
            # A header inside an article is the article's own; elsewhere, and with any other landmark, it is not.
            named = words & ASIDE_WORDS
            if not top and inside[-1]:
                named -= {"header"}
            if words & TELLING:
                named -= {"sidebar", "sidebars", "header", "footer", "nav", "navbar", "menu"}
            own_header = name in ("header", "hgroup") and not top and inside[-1] and not named
            landmark = (name in ASIDE and not own_header) or (bool(named) and name not in ("body", "html", "main")
                                                              and not (name == "article" and not words & {"comment", "comments"}))
            linked = template.get(path_id(walk.paths[-1]), 0.0) > MOSTLY_LINKS and name not in ("a", "body", "html") and not in_main
            inside.append(in_main)
            aside.append((not top and aside[-1]) or landmark or hidden or linked)
            if in_main and not aside[-1]:
                yield "main", "", 0, 0
            if name in VOID:
                for path in walk.close(name):
                    yield "close", path, 0, 0
                del inside[len(walk.names):], aside[len(walk.names):]
        elif kind == "close":
            if name in BLOCKS:
                yield from ended()
            for path in walk.close(name):
                yield "close", path, 0, 0
            del inside[len(walk.names):], aside[len(walk.names):]
            if name == "p" or name in BLOCKS:
                yield from ended()
        elif kind == "text":
            new = (inside[-1] if inside else False, aside[-1] if aside else False)
            if new != state:
                yield from ended()
                state = new
            if not now:
                where = walk.paths[-1] if walk.paths else ""
            now.append(text)
            size = len(text.strip())
            if size and walk.paths:
                yield "text", walk.paths[-1], size, size if "a" in walk.names else 0
    yield from ended()


def main_text(page: str, template: dict[int, float]) -> str:
    """The main text of a page: its blocks that fill slots of the template (token id to link share) and lie in no surroundings."""
    any_main, blocks = False, []
    for event in events(page, template):
        if event[0] == "main":
            any_main = True
        elif event[0] == "block" and not event[3][1] and template.get(event[1], 0.0) < TEMPLATE_TEXT:
            blocks.append((event[3][0], event[2]))
    texts = (SPACE.sub(" ", html.unescape(text).replace("\xa0", " ")).strip() for in_main, text in blocks if in_main or not any_main)
    return " ".join(text for text in texts if text)


#: A block of text is the template's if it is in this share of a host's pages and page contents, and in so many contents.
SHARED = 0.6
LEAST_CONTENTS = 9


def templates(pages: DataFrame, host: str, text: str, page: str) -> DataFrame:
    """(host, token, path, class, support, link_share): the template of each host.

    Tokens are elements, and blocks of text that most of the host's page contents have (null ``path``).  Tokens of the same occurrence vector over the host's pages form an equivalence class.  A class is valid if
    its tokens follow each other in one order wherever it occurs, and if all its occurrences lie in the same place of one
    class around it; valid classes, nested in each other, are the template, and the text between their tokens fills its slots.
    """
    narrow = pages.select(F.col(page).alias("page"), F.col(host).alias("host"), F.col(text).alias("html"))
    vectors = cut_lineage(
        narrow.mapInArrow(occurrences, "host string, token bigint, path string, vector bigint, pages bigint, contents bigint")
        .groupBy("host", "token").agg(
            F.first("path").alias("path"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("sum"), F.sum("pages").alias("pages"),
            F.bit_or("contents").alias("contents"))
        # A block that few contents have is what a page says; without these the table is as long as the templates.
        .filter(F.col("path").isNotNull() | (F.bit_count("contents") >= LEAST_CONTENTS))
        .select("host", "token", "path", "pages", F.bit_count("contents").alias("contents"), F.xxhash64(
            "host", F.expr("pmod(sum, 18446744073709551616BD)"), "pages").alias("class")))
    # The most that any token of a host has is what its pages have in common: their root.
    most = vectors.groupBy("host").agg(F.max("pages").alias("most_pages"), F.max("contents").alias("most_contents"))
    common = (F.col("pages") >= SHARED * F.col("most_pages")) & (F.col("contents") >= SHARED * F.col("most_contents"))
    vectors = cut_lineage(vectors.join(most, "host").filter(F.col("path").isNotNull() | common).drop("most_pages", "most_contents", "contents"))
    classes = vectors.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("classes"))
    found = (
        with_template(narrow, classes, "classes").select("host", "html", "classes")
        .mapInArrow(class_orders, "host string, class bigint, token bigint, low bigint, high bigint, parent_low bigint, "
                                  "parent_high bigint, text bigint, linked bigint")
        .groupBy("host", "class", "token").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("parent_low").alias("parent_low"),
            F.max("parent_high").alias("parent_high"), F.sum("text").alias("text"), F.sum("linked").alias("linked"))
        .filter("low = high and parent_low = parent_high"))
    return vectors.join(found, ["host", "class", "token"]).select(
        "host", "token", "path", "class", F.col("pages").alias("support"),
        F.when(F.col("path").isNull(), TEMPLATE_TEXT).when(F.col("text") > 0, F.col("linked") / F.col("text")).otherwise(0.0).alias("link_share"))


#: A host table of up to this many elements is broadcast; a larger one is joined by host and salt.
BROADCAST_ITEMS = 200_000
SALTS = 32


def with_template(pages: DataFrame, per_host: DataFrame, items: str) -> DataFrame:
    """``pages`` with the array ``items`` of their host from ``per_host`` (host, items), null for unknown hosts.

    The table is measured and broadcast if small; else every host's row is repeated per salt, so that the pages of a host
    with a third of all rows go to many tasks.
    """
    per_host = cut_lineage(per_host)
    if (per_host.agg(F.sum(F.size(items))).first()[0] or 0) <= BROADCAST_ITEMS:
        return pages.join(F.broadcast(per_host), "host", "left")
    salt, = fresh(pages, "salt")
    repeated = per_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (pages.withColumn(salt, F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
            .join(repeated, ["host", salt], "left").drop(salt))


def extract_text(pages: DataFrame, page: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(page, url, text): the main text of every page of ``pages``.

    Each host's template is deduced (:func:`templates`).  Blocks of text that belong to it are left out wherever they stand,
    also inside an article; what remains fills its slots.  Slots in menus, headers, footers, sidebars, notices, adverts,
    forms, comments and hidden elements hold no article, by the tags and names of the template around them; nor do
    slots whose text over all pages of the host is mostly links.  Where a page has an article or main element, its
    slots alone are read.  What is left keeps its order: references are decoded, white space inside a block becomes one
    space, blocks are joined by one space.

    Null and empty pages give the empty text; null urls share one template; hosts of fewer than nine different pages have no text of
    their template, so that there tags and names alone decide; copies of a page count as one; repeated rows are extracted alike; an unclosed element ends with the page.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    narrow = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(text), F.lit("")).alias("html"))
    learnt = templates(narrow, "host", "html", "page").filter(F.col("link_share") > MOSTLY_LINKS)
    # Only the tokens that decide a slot's role go back to the pages.
    roles = learnt.groupBy("host").agg(F.collect_list(F.struct("token", "link_share")).alias("roles"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(text, {r["token"]: r["link_share"] for r in roles or ()})
                   for text, roles in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page", "url", "text"])

    kind = pages.schema[page].dataType.simpleString()
    return with_template(narrow, roles, "roles").select("page", "url", "html", "roles").mapInArrow(
        extract, f"page {kind}, url string, text string").withColumnsRenamed({"page": page, "url": url})
