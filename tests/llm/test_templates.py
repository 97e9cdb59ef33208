from __future__ import annotations

from fleetlens.llm import templates

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x:1}}</style><script>var a = "</p>";</script></head><body>
<div class="cookie-banner">We use cookies</div><header><a href=/>Home</a></header>
<nav><ul><li><a href="/a">Menu {i}</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="sidebar"><p>Side {i}</p></div>
<article><header><h1>Title {i}</h1></header><p>First &amp; <b>bold</b> caf&eacute;   text
of {i}.<p>Second &#8212; <em>one</em>two.<!-- hidden {i} --><br>After<div class="ad">Buy {i}</div>
<form><input value=x><label>Name</label></form><aside>Related</aside><p hidden>gone</p></article>
<section id="comments"><article class="comment"><p>Nice post {i}</p></article></section>
<div class="ad">Advert {i}</div><footer>&copy; site</footer></body></html>"""
WANT = "Title {i} First & bold café text of {i}. Second — onetwo. After"


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, token string, roles int")
    return {r["page_id"]: r["text"] for r in templates.extract_text(df).collect()}


def test_article_without_what_surrounds_it(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i), "t", 1) for i in range(8)]
    assert texts(spark, rows) == {i: WANT.format(i=i) for i in range(8)}


def test_names_that_only_look_like_asides(spark):
    page = ("<body class='no-sidebar'><div class='wrap has-sidebar'><article><div class='entry-header'><h1>Head {i}</h1></div><p>Body {i}.</p>"
            "<div class='related-posts'>More</div></article></div><div class='page-header'>Site</div></body>")
    got = texts(spark, [(i, f"http://x.example/{i}", page.format(i=i), "t", 1) for i in range(3)])
    assert got == {i: f"Head {i} Body {i}." for i in range(3)}


def test_link_lists_without_names_are_found_by_their_template(spark):
    def page(i):
        return (f"<body><div class=top><span><a href=x>Go {i}</a> <a href=y>Elsewhere</a></span></div>"
                f"<div class=story><p>Words of story {i} with <a href=z>a link</a> inside of the sentence.</p></div></body>")
    got = texts(spark, [(i, f"https://news.example/{i}", page(i), "t", 1) for i in range(6)])
    assert got == {i: f"Words of story {i} with a link inside of the sentence." for i in range(6)}


def test_broken_empty_and_repeated_pages(spark):
    rows = [
        (1, "http://a.example/1", None, "t", 1), (2, "http://a.example/2", "", "t", 1), (3, None, "plain &lt;text&gt; &amp", "t", 1),
        (4, "not a url", "<p>one<p>two<div>three", "t", 1), (5, "http://b.example", "<article>cut <b>off</article><p>rest <i", "t", 1),
        (6, "http://c.example", "<article><p>same</p></article>", "t", 1), (6, "http://c.example", "<article><p>same</p></article>", "t", 1),
        (7, "http://d.example", "<article>" + "<p>long words</p>" * 20000 + "</article>", "t", 1),
        (8, "http://e.example", "<article><textarea>x</textarea><p>ok</p><script>never closed", "t", 1)]
    got = texts(spark, rows)
    assert (got[1], got[2], got[3]) == ("", "", "plain <text> &")
    assert (got[4], got[5], got[6], got[8]) == ("one two three", "cut off", "same", "ok")
    assert got[7] == " ".join(["long words"] * 20000)
    assert texts(spark, []) == {}


def test_classes_are_vectors_in_one_order(spark):
    page = "<body><div class=a><ul>{li}</ul></div><div class=b><p>x</p></div></body>"
    rows = [(i, "h", page.format(li="<li>y</li>" * (i + 1))) for i in range(4)]
    df = spark.createDataFrame(rows, "page bigint, host string, html string")
    got = {r["path"]: r for r in templates.templates(df, "host", "html", "page").collect()}
    assert got["/body"]["class"] == got["/body/div.b/p"]["class"] == got["/body/div.a/ul"]["class"]
    assert got["/body/div.a/ul/li"]["class"] != got["/body"]["class"] and got["/body"]["support"] == 4


def test_large_templates_are_joined_by_host_and_salt(spark, monkeypatch):
    monkeypatch.setattr(templates, "BROADCAST_ITEMS", 0)
    rows = [(i, "http://h.example", PAGE.format(i=i), "t", 1) for i in range(8)]
    assert texts(spark, rows) == {i: WANT.format(i=i) for i in range(8)}


def test_template_text_without_names_or_links_is_dropped(spark):
    """The block that all pages of a host share goes by the template alone, outside an article and inside of one."""
    def page(i, mark):
        return (f"<body><div class=x1><p>Welcome to the daily lantern, est. long ago.</p></div><{mark}><div class=x2>Story number {i} begins here.</div>"
                f"<div class=x3>Every story of ours is printed on paper.</div><p>It ends with {i * i}.</p></{mark}></body>")
    rows = [(i, f"http://a.example/{i}", page(i, "div"), "t", 1) for i in range(24)] + [(50 + i, f"http://b.example/{i}", page(i, "article"), "t", 1) for i in range(24)]
    got = texts(spark, rows)
    assert got == {k + i: f"Story number {i} begins here. It ends with {i * i}." for k in (0, 50) for i in range(24)}
    # Without the template the shared blocks stay: nothing else tells them apart.
    assert "Welcome to the daily lantern" in templates.main_text(page(3, "div"), {}) and "printed on paper" in templates.main_text(page(3, "article"), {})


def test_copies_of_a_page_are_no_template(spark):
    copy = "<body><div class=y><p>The same story, copied again and again.</p></div></body>"
    rows = [(i, f"http://c.example/{i}", copy, "t", 1) for i in range(30)]
    rows += [(40 + i, f"http://c.example/x{i}", f"<body><div class=y><p>Another story {i}.</p></div></body>", "t", 1) for i in range(6)]
    got = texts(spark, rows)
    assert {got[i] for i in range(30)} == {"The same story, copied again and again."} and got[43] == "Another story 3."


def brute_template_blocks(pages):
    """Blocks of a host that at least 0.6 of its different pages have, by sets of whole blocks."""
    different = list(dict.fromkeys(pages))
    sets = [{e[1] for e in templates.events(p, {}) if e[0] == "block"} for p in different]
    return {b for b in set().union(*sets) if sum(b in x for x in sets) >= max(0.6 * len(sets), 9)}


def test_template_blocks_are_those_that_most_pages_have(spark):
    import random
    rng = random.Random(5)
    lines = [f"Line {k} of the house" for k in range(12)]
    pages = ["<body>" + "".join(f"<div class=l{k}>{line}</div>" for k, line in enumerate(lines) if rng.random() < (k + 1) / 12) + f"<p>own {i}</p></body>"
             for i in range(25)]
    df = spark.createDataFrame([(i, "h", p) for i, p in enumerate(pages)], "page bigint, host string, html string")
    got = {r["token"] for r in templates.templates(df, "host", "html", "page").collect() if r["path"] is None}
    # 64 bits tell 25 contents apart but for a few: only clear cases are compared.
    clear = brute_template_blocks(pages)
    assert got and got <= clear | {e[1] for p in pages for e in templates.events(p, {}) if e[0] == "block" and e[2].startswith("Line")}
    assert {e[1] for e in templates.events(pages[0], {}) if e[0] == "block" and e[2] == "Line 11 of the house"} <= got
    assert not any(e[1] in got for p in pages for e in templates.events(p, {}) if e[0] == "block" and (e[2].startswith("own") or e[2] == "Line 0 of the house"))
