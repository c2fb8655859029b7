import html
import random

import pytest

from tessera.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><meta charset=utf-8><title>Head &amp; more</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header class="site"><a href="/">Site name</a></header><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad-banner">Buy this thing now</div>{open}{body}{close}
<section id="comments"><h3>Comments</h3><article class="comment"><p>I like this page a lot and write a long comment about it here</p></article></section>
<aside><p>Related things that are quite long to read as well</p></aside><form><label>Search</label><input name=q></form>
<footer>&copy; somebody</footer></body></html>"""
BODY = "<h1>A &lt;title&gt;</h1><p>First  para\n graph with <b>bold</b>face and <a href='x>y'>a link</a>.<p>Second one&nbsp;ends<br>here<div class=advert><p>Advert in between</p></div><script>x<y</script><ul><li>item one</li><li>item two</li></ul><p>Last words of it</p>"
TEXT = "A <title>\nFirst para graph with boldface and a link.\nSecond one ends here\nitem one\nitem two\nLast words of it"


@pytest.mark.parametrize("pair", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div><div id=x>", "</div></div>"), ("<article>", "")])
@pytest.mark.parametrize("weights", [h.DEFAULT, h.weigh(dict(h.evidence(PAGE.format(open="<article>", body=BODY, close="</article>"))))])
def test_regions(pair, weights):
    assert h.main_text(PAGE.format(open=pair[0], body=BODY, close=pair[1]), weights) == TEXT


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<nav>a b</nav>", ""), ("<p>unclosed <b>bold", "unclosed bold"), ("<p>cut off <a href='", "cut off"), ("<p>x &am", "x &am"), ("a < b and c > d", "a < b and c > d"), ("<p>" * 3000 + "deep" + "<div>" * 500, "deep")])
def test_odd_pages(page, text):
    assert h.main_text(page, h.DEFAULT) == text


@pytest.mark.parametrize("page", [
    "<body><nav>one two</nav><article class='post comment-status-open'><p>{}</p></article></body>",
    "<body><nav>one two</nav><article class='has-comments'><p>{}</p></article></body>",
    "<body><div class='main-nav-layout'><ul class=nav><li>one</ul><p>{}</p></div><div id=footer>two</div></body>",
    "<body><p>{}</p><div class='comments'><p>one</p></div><div role='discussion'>two</div></body>"])
def test_firm_names_are_whole_words(page):
    text = "good words with <span class='comment'>a remark</span> in the code and more of them"
    for weights in [h.DEFAULT, *([h.weigh(dict(h.evidence(page.format(text))))] if "<article" in page else [])]:
        assert h.main_text(page.format(text), weights) == "good words with a remark in the code and more of them"


def test_learnt_odds_overrule_firm_names():
    page = "<body><nav>junk</nav><article><p>good words</p><aside><p>a long note that belongs here</p></aside></article></body>"
    counts = sum((h.evidence(page.replace("long", "long " * 200)) for _ in range(30)), h.Counter())
    assert h.main_text(page, h.weigh(dict(counts))) == "good words\na long note that belongs here"
    assert h.main_text(page, h.DEFAULT) == "good words"


def test_class_names_are_learnt():
    pages = [f"<body><div class='zq'>{'junk words ' * 5}</div><article><p>{'good words ' * 20}</p></article><div class='zq'>{'more junk ' * 5}</div></body>" for _ in range(30)]
    counts = sum((h.evidence(p) for p in pages), h.Counter())
    page = "<body><p>good words here</p><div class='zq'>junk words</div><p>and good words there</p></body>"
    assert h.main_text(page, h.weigh(dict(counts))) == "good words here\nand good words there"
    assert "junk" in h.main_text(page, h.DEFAULT)


def test_long_page():
    rng = random.Random(1)
    lines = [" ".join("".join(rng.choices("abc<&>é", k=5)) for _ in range(12)) for _ in range(20_000)]
    page = PAGE.format(open="<article>", body="".join(f"<p>{html.escape(x)}</p>" for x in lines), close="</article>")
    assert h.main_text(page, h.DEFAULT) == "\n".join(lines)


def test_query_finds_the_articles(spark):
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = h.op7_html_extract(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        inside = rows[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = (re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(filter(None, (" ".join(html.unescape(x).split()) for x in parts))) and r.n_chars == len(r.text)


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (None, None, "<article>x</article>", 3), (2, "u", "<p>y", 3), (2, "u", "<p>y", 3)], "page_id long, url string, html string, n_chars int")
    out = h.extract(df, h.fit(df))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=str) == [(1, "", 0), (2, "y", 1), (2, "y", 1), (None, "x", 1)]
    assert h.extract(df.limit(0), h.fit(df.limit(0))).count() == 0
