"""Main text of written pages."""

from wirelens.llm import html


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = [
    (page("<nav><ul><li><a href=/x>Menu</a></ul></nav><article><h1>A &amp; B</h1><p>one\n  <b>two</b><br>three<p>four</article><footer>end</footer>"), "A & B\n\none two three\n\nfour"),
    (page("<main><p>x &lt;y&gt; &#233;&nbsp;z</p><aside>side</aside><div class='comments'><p>nice</p></div><form><p>sign</p></form></main>"), "x <y> é z"),
    (page("<div class=ad>buy</div><div id='cookie-notice'>cookies</div><div><p>only text</p>tail</div><script>var a='<p>no</p>';</script>"), "only text\n\ntail"),
    (page("<article><header><h1>Head</h1></header><p>a < b</p><!-- <p>no --><table><tr><td>c<td>d</table><p hidden>h</p></article>"), "Head\n\na < b\n\nc\n\nd"),
    (page("<article><p>open <i>end</article><p>after"), "open end"),
    ("just words", "just words"), ("", ""), (None, ""), ("<p>cut <a href='", "cut"), ("<style>p{}", ""), ("<div>" * 3000 + "deep", "deep"),
]


def test_pages(spark):
    rows = [(i, f"http://h{i}.example.com/p", h) for i, (h, _) in enumerate(CASES)] + [(None, None, "<p>no id</p>"), (0, "http://h0.example.com/p", CASES[0][0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as dull")
    found = html.extract_text(pages).collect()
    got = sorted(((r.page_id, r.text, r.n_chars) for r in found), key=repr)
    wanted = [(i, t, len(t)) for i, (_, t) in enumerate(CASES)] + [(None, "no id", 5), (0, CASES[0][1], len(CASES[0][1]))]
    assert got == sorted(wanted, key=repr)
    assert html.extract_text(pages.limit(0)).count() == 0


def test_style_tree(spark):
    """What a site repeats outside of its articles goes, what it says once stays."""
    rows = [(i, "https://u@Site.example.com:80/x", page(f"<div class='strip'>Same on every page</div><div class='body'><p>Text {i} of its own</p></div>")) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html.extract_text(pages).collect()} == {i: f"Text {i} of its own" for i in range(12)}
    nodes = html.style_tree(pages).collect()
    assert {r.host for r in nodes} == {"site.example.com"} and all(0 <= r.importance <= 1.0000001 for r in nodes)
    # On a site of one page nothing repeats.
    assert html.extract_text(pages.limit(1)).first().text == "Same on every page\n\nText 0 of its own"


def test_names_in_articles(spark):
    """Inside an article, ids and parts of names are no aside; whole tokens and known compounds are."""
    body = ("<article><h2 id='related-work'>Related work</h2><section id='social-history'><p>history</p></section><div class='share-prices'>prices</div>"
            "<div class='related-posts'>more</div><ul class='big share'><li>tweet</li></ul><div role='search'>find</div><p id='notice'>end</p></article><div id='cookie-notice'>cookies</div>")
    pages = spark.createDataFrame([(1, "http://a.example.com/", page(body))], "page_id bigint, url string, html string")
    assert html.extract_text(pages).first().text == "Related work\n\nhistory\n\nprices\n\nend"


def test_copies(spark):
    """Copies of a page are no evidence of what its site repeats."""
    lone, strip = page("<div><p>text</p><p>text</p></div>"), "<div class='strip'>Same on every page</div>"
    rows = [(i, url, lone) for i, url in enumerate(["http://a.example.com/1", "http://a.example.com/2", None, None, "http://b.example.com/"])]
    rows += [(10 + i, f"http://c.example.com/{i}", page(f"{strip}<div class='body'><p>Text {max(0, i - 90)} of its own</p></div>")) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wanted = {i: "text\n\ntext" for i in range(5)} | {10 + i: f"Text {max(0, i - 90)} of its own" for i in range(100)}
    assert {r.page_id: r.text for r in html.extract_text(pages).collect()} == wanted
