import gzip
import hashlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from coinbrook.llm import extraction, warc
from coinbrook.llm.dom import parse
from coinbrook.sinks.scratch import scratch_path

PAGES = "page_id long, url string, html string"


def pages_of(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")


# -- archives ------------------------------------------------------------------------------


def expected(rows):
    first, out = {}, {}
    for page_id, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        least = first.setdefault(digest, page_id) if len(data) >= 100 else page_id
        out[page_id] = (len(data), digest, "response" if least == page_id else "revisit", None if least == page_id else least)
    return out


def read_back(spark, frame):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(spark, frame).collect()}


def test_round_trip_of_test_pages(spark, sf):
    pages = pages_of(spark, sf)
    assert read_back(spark, pages) == expected([tuple(r) for r in pages.collect()])


def test_shared_payloads_nulls_and_odd_urls(spark):
    long, other = "<p>" + "é" * 60, "<b>" + "x" * 200
    rows = [(k, f"http://a.example/{k % 3}", long) for k in range(20, 5, -1)]
    rows += [(1, None, None), (2, "no url", ""), (3, "http://B.example:80/x\r\ny", "short"), (4, "http://b.example/", "short"), (5, "http://b.example/ü", other), (30, "http://b.example/", other)]
    frame = spark.createDataFrame(rows, PAGES)
    assert read_back(spark, frame) == expected(rows)


def test_repeated_rows_and_null_ids(spark):
    html = "<p>" + "z" * 200
    rows = [(7, "http://a/", html), (7, "http://a/", html), (None, "http://a/", html), (None, None, "q" * 150)]
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_read(spark, spark.createDataFrame(rows, PAGES)).collect()), key=repr)
    assert got == sorted([(7, "response", None, 203), (7, "response", None, 203), (None, "revisit", 7, 203), (None, "response", None, 150)], key=repr)


def test_no_pages(spark):
    assert read_back(spark, spark.createDataFrame([], PAGES)) == {}


def test_keys_reverse_hosts(spark):
    urls = ["http://WWW.b.Example.com:80/p?q#f", "//u:p@h.org", "mailto:x", None, "https://h.org"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,b,www)/p?q#f", "org,h)", "mailto:x", "", "org,h)"]


def test_lookups_find_all_captures_of_a_url(spark, monkeypatch):
    """Blocks of two captures, so that captures of one key lie in several blocks and archives."""
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 2)
    rows = [(k, f"http://s{k % 4}.example/", f"page {k}") for k in range(40)]
    path = scratch_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    index = warc.CaptureIndex(path)
    for s in range(4):
        key = f"example,s{s})/"
        assert sorted(c.page_id for c, _ in index.of_key(key)) == [k for k in range(40) if k % 4 == s]
        assert [c.page_id for c, _ in index.of_page(key, 12 + s)] == [12 + s]
    assert list(index.of_key("example,s9)/")) == [] and list(index.of_page("example,s1)/", 2)) == []
    keys = spark.createDataFrame([("example,s1)/",), ("example,zz)/",)], "key string")
    assert sorted(bytes(r.payload).decode() for r in warc.lookup(keys, path).collect()) == sorted(f"page {k}" for k in range(1, 40, 4))


def test_archives_are_gzip_members_with_warc_headers(spark):
    path = scratch_path(spark, "warc-test")
    manifest = warc.write_archive(spark.createDataFrame([(1, "http://a/", "x")], PAGES), path)
    name = manifest.collect()[0].archive
    files, local = warc.file_system(name)
    data = files.open_input_file(local).read()
    assert data[:2] == b"\x1f\x8b"
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") >= 2 and b"WARC-Type: warcinfo" in text and b"WARC-Target-URI: http://a/" in text
    assert pq.read_table(path.removeprefix("file://") + "/manifest").num_rows == 1


# -- extraction ----------------------------------------------------------------------------


def extracted(spark, rows):
    return {r.page_id: (r.text, r.n_chars) for r in extraction.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_articles_of_test_pages(spark, sf):
    """The generator of the test pages puts the article, and nothing else, into <article>."""
    import html
    import re

    pages = pages_of(spark, sf)
    found = {r.page_id: r for r in extraction.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert found[p.page_id].text == want and found[p.page_id].n_chars == len(want)
        assert found[p.page_id].url == p.url


def test_regions_around_and_inside_the_article(spark):
    page = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav>Menu</nav><div id="cookie-notice">Cookies!</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld<br>line.
    <p>Two&nbsp;&#233;<script>var x = "<p>no</p>";</script><!-- no --><div class="ad-box">Buy</div>
    <form><input><label>Mail</label></form><table><tr><td>c1<td>c2</table><ul><li>x<li>y</ul></article>
    <section class="comments"><article>Nice post</article></section><aside>Related</aside></main>
    <div role="contentinfo">Imprint</div><footer>Foot</footer></body></html>"""
    got = extracted(spark, [(1, "http://a/", page)])
    assert got[1][0] == "Title & more One bold line. Two é c1 c2 x y"


def test_marked_wrappers_around_the_article(spark):
    """Names that stand for the layout of the whole page do not drop it."""
    story = "<h1>Title</h1><p>A story that is told at some length.</p>"
    menu = "<nav>" + "Menu " * 40 + "</nav>"
    pages = [
        f'<body class="has-sidebar">{menu}<div>{story}</div><div class="sidebar">Side</div></body>',
        f'<body><div class="layout-right-sidebar"><div id="content">{story}</div></div><div class="widget">Side</div></body>',
        f'<body><table><tr><td class="with-sidebar">{story}</td><td class="sidebar">Side</td></tr></table></body>',
        f'<body><section class="no-comments">{story}</section><div id="comments">Nice post</div></body>',
        f'<body>{menu}<article><div class="entry no-sidebar">{story}</div><div class="share">Share</div></article></body>',
        f'<body><div class="page search"><div role="main">{story}</div></div>{"<p>More</p>" * 40}</body>',
        f'<body><main>{story}<div class="comments">{"<p>Nice post</p>" * 30}</div></main></body>',
        f'<body><div>{story}</div><div hidden>{"not shown " * 40}</div></body>',
    ]
    got = extracted(spark, [(k, f"http://h{k}.example/", p) for k, p in enumerate(pages)])
    assert [got[k][0] for k in range(len(pages))] == ["Title A story that is told at some length."] * len(pages)


def test_templates_of_a_host_without_semantic_tags(spark):
    rows = []
    for k in range(20):
        body = f"<div class=top>My site</div><div><a href=/a>Page {k}</a> <a href=/b>More {k}</a></div><div class=text><p>Story {k} of many.</p><p>Goes on {k * k}.</p></div><div>All rights reserved</div>"
        rows.append((k, "http://h.example/x", f"<html><body>{body}</body></html>"))
    got = extracted(spark, rows)
    assert got[3][0] == "Story 3 of many. Goes on 9."


def test_nulls_empty_broken_and_deep_pages(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", "just text < 3 &lt;"), (4, "x", "<div>" * 3000 + "deep"), (5, None, "<p>a<p>b</i>c"), (6, "http://a/", '<p title="a>b">q</p'), (None, "u", "<p>n")]
    got = extracted(spark, rows)
    assert got[1] == ("", 0) and got[2] == ("", 0)
    assert got[3][0] == "just text < 3 <" and got[4][0] == "deep" and got[5][0] == "a bc" and got[6][0].startswith("q")
    assert got[None][0] == "n"
    assert extracted(spark, []) == {}


def test_a_few_equal_pages_are_content(spark):
    rows = [(k, "http://m.example/", "<article><h1>Same</h1><p>Text</p></article>") for k in range(30)]
    assert set(extracted(spark, rows).values()) == {("Same Text", 9)}


def test_matching_keeps_order_and_inserts():
    one = extraction.slots_of(parse("<div><h1>a</h1><p>x</p><em>f</em></div>"))
    two = extraction.slots_of(parse("<div><p>y</p><hr><em>f</em></div>"))
    extraction.merge(one, two)
    div = one.kids[0]
    assert [(k.label, k.pages, k.text == extraction._VARIES) for k in div.kids] == [("h1", 1, False), ("p", 2, True), ("hr", 1, False), ("em", 2, False)]
