import re

from flowloom.llm.html_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div>
<article><h1>T &amp; U</h1><p><b>Bold.<br>next<p>a  b&nbsp;c &lt;i&gt; 1 < 2</p><div class="share-buttons">Share</div><ul><li>one<li>two</ul>
<form>Sign <input name=q></form><p>in<i>line</i> x</p><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><div class='cookie-notice'>Cookies</div><footer>&copy; me</footer></body></html>"""


def test_parts():
    assert main_text(PAGE) == "T & U\nBold. next\na b c <i> 1 < 2\none\ntwo\ninline x"


def test_broken_and_odd():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<!-- x") == main_text("<script>a<b>") == ""
    assert main_text("plain &am &amp text &#x41;") == "plain &am & text A"
    assert main_text("<div>a<p>b<p>c<div>d</div>e</div>f") == "a\nb\nc\nd\ne\nf"
    assert main_text("<b><p>x</b>y</p>z</b>") == "xy\nz"
    assert main_text("<article>a</article><div>no</div><article>b<article class=comment>no</article></article>") == "a\nb"
    assert main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "x") == "deep\nx"


def test_site_templates(spark):
    page = lambda i, host: f"<div><p>Welcome to {host}</p></div><div><p>Text {i} of {host}</p><p>Common</p></div><div>All rights</div>"
    rows = [(i, f"http://{'one' if i % 3 else 'two'}.example.com/{i}", page(i, i % 3 > 0)) for i in range(30)]
    rows += [(100, "http://alone.example.com/", page(1, 0)), (101, None, None), (102, "x", ""), (None, None, "<p>q</p>"), (103, "http://ONE.example.com:80/a", page(5, True)), (103, "http://ONE.example.com:80/a", page(5, True))]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, hashes int").repartition(3)
    got = {(r.page_id, r.text, r.n_chars) for r in extract(df).collect()}
    assert (4, "Text 4 of True", 14) in got and (3, "Text 3 of False", 15) in got
    assert (100, "Welcome to 0\nText 1 of 0\nCommon\nAll rights", 42) in got
    assert {(101, "", 0), (102, "", 0), (None, "q", 1), (103, "Text 5 of True", 14)} <= got
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


def test_templates_with_articles(spark):
    menu, own = "<div><p>Home of the menu</p></div>", "<div><p>Own text {0} of this page, in divs</p></div>"
    forms = ["<article><p>Text {0} is long enough to be most of it</p><p>Read more on us</p></article>", own + "<article class=comment>Nice {0}</article>", own + "<!-- <article> -->", own + "<script>'<main>'</script>", own + "<article>Tease {0}</article>"]
    rows = [(i, f"http://a.example.com/{i}", menu + forms[0 if i < 30 else i % 4 + 1].format(f"n{i}")) for i in range(50)]
    # copies of one page are no template
    rows += [(i, "http://b.example.com/", "<article><p>Same</p></article>") for i in range(100, 120)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"Text n{i} is long enough to be most of it" for i in range(30)) and all(got[i] == "Same" for i in range(100, 120))
    body = "Own text n{0} of this page, in divs"
    assert all(got[i] == body.format(i) + (f"\nTease n{i}" if i % 4 == 3 else "") for i in range(30, 50))


def test_large_host(spark):
    page = lambda i: f"<div><p>Text {i}</p></div>" + ("<div><p>Menu of a section</p></div>" if i % 10 == 0 else "")
    df = spark.createDataFrame([(i, "http://large.example.com/", page(i)) for i in range(400)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: f"Text {i}" for i in range(400)}


def test_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)
