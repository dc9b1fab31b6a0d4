"""Main text of pages: shapes of real pages, linear time, votes of hosts by both ways of attaching them."""

from __future__ import annotations

import time
import tracemalloc
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colsight.llm import pages
from colsight.llm.pages import Page, extract_pages, main_text

PAGE = (
    '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div>{}<footer>&copy; x</footer></body></html>'
)


def test_pages(spark):
    rows = [
        (0, "http://a.org/1", PAGE.format("<article><h1>Top</h1><p><b>One\n two<br>three<p>fo<i>u</i>r &amp; &lt;five&gt;&nbsp;<script>x</script></article>")),
        (1, "http://a.org/2", PAGE.format("<article><p>Short</p><div class='comments'>Nice!</div><aside>No</aside><form>No</form></article>")),
        (2, "http://b.org/1", PAGE.format('<div class="post-12"><p>' + "Long body text. " * 20 + '</p></div><div class="sidebar">Links</div>')),
        (3, "http://b.org/2", PAGE.format('<div class="post-77"><p>Tiny.</p></div><div class="box"><p>Subscribe to our very long letter, please do.</p></div>')),
        (4, None, None), (5, "", ""), (6, "http://c.org", "no tags &eacute;"), (7, "http://c.org", "<p>cut <!-- off"), (7, "http://c.org", "<p>cut <b>off</b"),
    ]
    rows += [(10 + i, "http://b.org/x", rows[2][2]) for i in range(3)]
    table = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text) for r in extract_pages(table).orderBy("page_id", "text").collect()]
    assert got[:9] == [
        (0, "Top One two three four & <five>"), (1, "Short"), (2, " ".join(["Long body text."] * 20)), (3, "Tiny."), (4, ""), (5, ""), (6, "no tags é"), (7, "cut"), (7, "cut off"),
    ]
    assert extract_pages(table.where("page_id < 0")).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<div class="page has-sidebar"><article>Body text</article></div>', "Body text"),
        ('<body class="no-sidebar"><div class="header-fixed"><article><p>A</article></div><footer>f</footer>', "A"),
        ('<form id="aspnetForm"><div><p>In the form</p></div></form>', "In the form"),
        ('<div id="wrap"><form id="aspnetForm"><div class="sidebar">side</div><main><h1>T</h1><p>Main</main></form></div>', "T Main"),
        ("<p title=it's>Lost</p><p>more</p>", "Lost more"),
        ('<p title="a > b" data-x=\'<p>\'>Quoted</p>', "Quoted"),
        ("<article><header><h1>Title</h1></header><p>x</p></article>", "Title x"),
        ("<header><h1>Site</h1></header><article><p>x and y</p></article>", "x and y"),
        ('<article><section class="social-science"><p>abc</p></section></article>', "abc"),
        ("<article>y <button>Click</button> z <span class=ad>buy</span>end</article>", "y z end"),
        ('<article><p>A</p><div class="comments"><article>' + "long comment " * 20 + "</article></div></article>", "A"),
        ('<article><p>A</p></article><div class="comment-list"><p>' + "long comment " * 20 + "</p></div>", "A"),
        ('<div class="cookie-banner">We use cookies, many of them.</div><p>Hi</p>', "Hi"),
        ("<p>a<p>b<ul><li>c<li>d</ul>e<table><tr><td>f<td>g<tr><td>h</table>", "a b c d e f g h"),
        ("<article>a &amp; b&nbsp;&eacute; &#x41;\n\t c<br>d<!-- no --></article>", "a & b é A c d"),
        ("<nav>only a menu</nav>", ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<article>cut <b", "cut"),
    ],
)
def test_shapes(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source", ["<div>x" * 51_200, "<b>" * 20_000 + "<h1></h1>" * 20_000 + "</i>" * 20_000, "<table>" * 20_000 + "<tr><td>" * 20_000, "<p " + 'a="b" ' * 50_000])
def test_long_nested_pages_take_linear_time_and_memory(source):
    started = time.perf_counter()
    Page(source).scored()
    assert time.perf_counter() - started < 4  # a second on an idle machine; minutes when quadratic
    tracemalloc.start()
    Page(source).scored()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def brute(rows):
    """Votes added up and paths chosen without Spark."""
    votes, parsed = defaultdict(lambda: defaultdict(float)), []
    for _, site, source in rows:
        blocks, spans, best, vote = Page(source or "").scored()
        parsed.append((blocks, spans))
        if best >= 0:
            votes[site][spans[best][0]] += round(vote, 6)
    out = []
    for (key, site, _), (blocks, spans) in zip(rows, parsed, strict=True):
        ranked = sorted((-round(votes[site][p], 6), p) for p, _, _ in spans if p in votes[site])
        out.append((key, " ".join(" ".join(blocks[a:b]) for p, a, b in spans if ranked and p == ranked[0][1])))
    return sorted(out)


@pytest.mark.parametrize("sent", [32 << 20, -1])
def test_votes_by_both_ways_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(pages, "SENT_BYTES", sent)
    monkeypatch.setattr(pages, "HOT_SHARE", 2)
    shapes = [
        '<div class="post-{n}"><p>{t}</p></div><div class="box"><p>{u}</p></div>', "<article><p>{t}</p></article><div><p>{u}</p></div>",
        '<div class="k{n}"><div class="post-1"><p>{t}</p></div><div class="post-2"><p>{u}</p></div></div>', "<table><tr><td>{t}</td><td>{u}</td></tr></table>", "<p>{t}</p>", "", None,
    ]
    rows = []
    for i in range(200):
        shape = shapes[(i * i + i // 7) % len(shapes)]
        source = shape and shape.format(n=i % 3, t="word " * (1 + i * 7 % 23), u="other " * (1 + i * 5 % 29))
        rows.append((i // 2, "hot.org" if i % 3 else f"h{i % 8}.org", source))
    table = spark.createDataFrame([(k, f"http://{s}/{k}", h, "a", "b", 3, "c") for k, s, h in rows], "page_id long, url string, html string, row string, site string, own int, _blocks string")
    found = extract_pages(table.repartition(5))
    assert found.columns == [*table.columns, "text"]
    assert sorted((r.page_id, r.text) for r in found.collect()) == brute(rows)
    assert found.where("row <> 'a' or site <> 'b' or own <> 3 or _blocks <> 'c'").count() == 0
    with pytest.raises(ValueError, match="text"):
        extract_pages(table.withColumn("text", F.lit(1)))
