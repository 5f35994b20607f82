"""Main text of pages: tree matching, templates with and without telling names, odd markup."""

from gapfeed.llm import html_extract as H


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")


def texts(spark, rows):
    return {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}


BODY = """<html><head><title>T</title><script>var a = "</p><p>no";</script><style>p{{}}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title {i}</h1></header><p>First {i} &amp; <b>bo</b>ld&nbsp;text<br>next</p><div class="advert">Buy {i}!</div><p>Second   {i}
line<p>Third {i} &lt;tag&gt; a < b<ul><li>one {i}<li>two</ul><form><input value="x"><button>Send</button></form></article>
<section id="comments"><p>Reader {i} says</p></section></main><aside>Side {i}</aside><footer>&copy; me</footer></body></html>"""


def test_named_parts(spark):
    got = texts(spark, [(i, "http://h.example/p", BODY.format(i=i)) for i in range(8)])
    for i, t in got.items():
        assert t == f"Title {i} First {i} & bold text next Second {i} line Third {i} <tag> a < b one {i} two"


PLAIN = """<body><div class="a1"><a href="/">Start</a> <a href="/x">News</a> <a href="/y">More</a></div>
<div class="b2"><div class="c3"><p>Share this page</p></div><div class="d4"><p>{text}</p><p>{more}</p></div></div>
<div class="e5"><p>All rights kept</p></div></body>"""


def test_constant_nodes_become_template(spark):
    rows = [(i, "https://plain.example:80/x", PLAIN.format(text=f"The story number {i} begins here with many words. " * 4, more=f"And it goes on {i} until the end. " * 3)) for i in range(12)]
    for i, t in texts(spark, rows).items():
        assert t.startswith(f"The story number {i} begins") and t.endswith(f"goes on {i} until the end.")
        assert "Share" not in t and "rights" not in t and "News" not in t


def test_names_never_drop_the_whole_page(spark):
    page = '<html class="form"><body class="has-sidebar"><main id="search-results"><article class="post comments-open"><p>Story {i} of the day</p></article></main></body></html>'
    assert texts(spark, [(i, "http://names.example/p", page.format(i=i)) for i in range(6)]) == {i: f"Story {i} of the day" for i in range(6)}


def test_title_and_lead_stay(spark):
    page = "<body><div class=post><h1>Title {i}</h1><p>Lead {i}</p><div class=body><p>{t}</p></div></div><div class=end><p>All rights kept</p></div></body>"
    rows = [(i, "http://lead.example/p", page.format(i=i, t=f"Long story {i} " * 30)) for i in range(8)]
    for i, t in texts(spark, rows).items():
        assert t.startswith(f"Title {i} Lead {i} Long story {i}") and t.endswith(f"story {i}")


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "http://x", "just text &eacute; <b>bold"), (4, "http://x", "<p>one<p>two<div>three"), (5, "bad url", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (6, "http://y", "<!-- open comment <p>hidden"), (7, "http://y", "<script>x"), (8, "http://z", "<p>" + "long " * 50_000), (9, "http://w", "a <3 b <"), (9, "http://w", "a <3 b <"), (None, "http://v", "<p>no id</p>"), (10, "http://q", '<p title="un>closed>text</p>'),
    ]
    got = H.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[6] == by[7] == "" and by[3] == "just text é bold" and by[4] == "one two three" and by[5] == "deep"
    assert by[8] == " ".join(["long"] * 50_000) and by[9] == "a <3 b <" and by[None] == "no id"
    assert all(r.n_chars == len(r.text) for r in got)


def test_tree_matching():
    a = H.shape([H.parse("<div><p>x</p><ul><li>1<li>2</ul><h2>y</h2></div>")])
    b = H.shape([H.parse("<div><ul><li>9</ul><p>z</p><h2>w</h2></div>")])
    pairs = []
    assert H.align(a, b, pairs) == 5 == len(pairs)  # root, div, then ul with li and h2, or p and h2
    assert H.align(a, a) == len(H.numbered(a))
    restored = H.from_json(H.to_json(a))
    assert H.align(a, restored[0]) == len(restored)


def test_joined_references(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/p", BODY.format(i=i)) for i in range(9)]
    want = texts(spark, rows)
    monkeypatch.setattr(H, "BROADCAST_HOSTS", 1)
    assert texts(spark, rows) == want


def test_empty(spark):
    assert H.extract(pages(spark, [])).count() == 0
