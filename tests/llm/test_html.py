"""Main text: pages of many layouts that the labelled table doesn't hold, the given pages against SQL, odd markup and tables."""

import time

import duckdb
import numpy as np
import pytest

from gramwise.llm import html
from gramwise.llm.queries import SQL

A = "Rain fell on the harbour for three days, and the boats stayed in. Nobody in the market spoke of fish any more until the wind had turned."
B = "The ferry came late."
C = "On the fourth day the harbour master opened the gates & the crews, who had waited in the inn, went out with the tide before the light was up."
MENU = '<ul class="main-nav"><li><a href="/">Home</a></li><li><a href="/a">About the harbour and its people</a></li></ul>'
BODY = f"<h1>Storm</h1><p>{A}</p><p>{B}</p><p>Gone.</p><p>{C.replace('&', '&amp;')}</p>"
TEXT = "\n\n".join(("Storm", A, B, "Gone.", C))

PAGES = {
    "article alone": f"<article>{BODY}</article>",
    "article first": f"<article>{BODY}</article><footer>{A}</footer>",
    "nothing closed": f"<body><nav>{MENU}</nav><article><h1>Storm<p>{A}<p>{B}<p>Gone.<p>{C.replace('&', '&amp;')}</article>",
    "main and sidebar": f'<header><a href="/">Site</a><p>{A}</p></header><main>{BODY}</main><div class="sideBar right"><p>{A}</p><p>{C}</p></div>',
    "sidebar first": f'<aside><p>{A}</p></aside><main>{BODY}</main>',
    "names only": f'<div id="top-menu">{MENU}</div><div class="post-content">{BODY}</div><div class="site-footer"><p>{A}</p></div>',
    "advert inside": f'<article>{BODY.replace("<p>Gone", f"<div class=ad><p>{A}</p></div><p>Gone")}</article>',
    "notice before": f'<div class="cookie-consent"><p>{A}</p><button>Accept all of it</button></div><article>{BODY}</article>',
    "comments": f'<article>{BODY}<div id="comments"><h2>2 comments</h2><article class="comment"><p>{A}</p></article><p>{C}</p></div></article>',
    "forms": f'<article>{BODY}</article><form action="/s"><p>{A}</p><input name="q"><select><option>One</option></select><label>Name</label></form>',
    "scripts": f'<article><script>if (a < b) document.write("<p>{A}</p>")</script>{BODY}<style>p {{ margin: 0 }}</style><!-- <p>{A}</p> --><noscript><p>{A}</p></noscript></article>',
    "hidden": f'<article>{BODY}<div hidden><p>{A}</p></div><div style="display: none"><p>{A}</p></div></article>',
    "no hints": f"<div><a href='/'>Home</a> <a href='/b'>Boats</a></div><h1>Storm</h1><p>{A}</p><p>{B}</p><p>Gone.</p><p>{C.replace('&', '&amp;')}</p><div><a href='/t'>Terms</a></div>",
    "attributes": f'<article data-x="a > b" title=\'"\'>{BODY}</article>',
    "header in article": f"<article><header><h1>Storm</h1></header>{BODY.removeprefix('<h1>Storm</h1>')}</article>",
    "cut off": f'<nav>{MENU}</nav><article>{BODY}</article><footer>{A}</footer><a href="/unfinished',
    "upper case": f"<BODY><NAV>{MENU}</NAV><ARTICLE>{BODY.replace('<p>', '<P>').replace('</p>', '</P>')}</ARTICLE></BODY>",
    "list and table": f"<nav>{MENU}</nav><article><h1>Storm</h1><ul><li>{A}</li><li>{B}</li></ul><table><tr><td>Gone.</td></tr></table><div>{C.replace('&', '&amp;')}</div></article>",
    "tail": f"<article>{BODY}</article><script>var t = '<p>never closed</p>'",
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    assert html.main_text(PAGES[name], html.learned()) == TEXT


def test_main_parts_are_kept_whole():
    """Whatever their size and place, blocks of an article that aren't links stay, and what stands beside it goes."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        texts = [" ".join(rng.choice(A.split(), rng.integers(1, 60))) for _ in range(rng.integers(1, 9))]
        tags = rng.choice(["p", "div", "li", "blockquote", "h2", "td", "pre"], len(texts))
        page = "<article>" + "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, texts, strict=True)) + "</article>"
        around = [f"<nav>{MENU}</nav>", f'<div class="ad">{A}</div>', f"<footer>{B}</footer>"]
        page = "".join(x for x in around[:2] if rng.random() < 0.5) + page + (around[2] if rng.random() < 0.5 else "")
        assert html.main_text(page, html.learned()) == "\n\n".join(texts)


def test_labels_are_learned():
    nodes = html.learned()
    for page in html.PAGES:
        found = html.blocks("".join(x for x, _ in page))
        labels, before, text = [], 0, ""
        for piece, label in page:
            text += piece
            labels += [label] * (len(html.blocks(text)) - before)
            before = len(labels)
        assert html.kept(list(nodes), html.features(found)).tolist() == list(map(bool, labels))


def test_tree_against_all_splits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    y = (x[:, 0] > 1) ^ (x[:, 2] > 2)
    assert (html.kept(html.grow(x, y), x) == y).all()
    tree = html.grow(x, y, 1)

    def impurity(f, most):
        return sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[x[:, f] <= most], y[x[:, f] > most]) if len(p))

    assert impurity(tree[0].feature, tree[0].most) == pytest.approx(min(impurity(f, m) for f in range(3) for m in (0.5, 1.5, 2.5)))


def test_text_of_blocks():
    page = "<p>a&nbsp;&amp;amp;\n\t b<br>c <b>d</b>e</p><p> </p>&#x41;&lt;p&gt;"
    assert [b.text for b in html.blocks(page)] == ["a &amp; b c de", "A<p>"]
    assert html.blocks("<p><a href=x>one two</a> three")[0][:3] == ("one two three", 3, 2)
    assert html.blocks("") == [] and html.blocks("<") == html.blocks("<")


def test_long_and_odd_markup_is_read_in_linear_time():
    start = time.time()
    for page in ("<" * 200_000, "<a " * 50_000, "<p>" * 200_000, "<div>" * 50_000 + "x", '<a href="' * 50_000, "<!--" * 50_000, "&" * 300_000, "<p>word word</p>" * 40_000, "</div>" * 50_000):
        html.main_text(page, html.learned())
    assert time.time() - start < 60


def test_given_pages_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    got = html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(SQL["op12_html_text"]).fetchall())


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (None, "u", PAGES["comments"], "x", 1), (2, "u", "", "x", 1), (2, "u", "", "x", 1)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(got, key=str) == sorted([(1, None, "", 0), (None, "u", TEXT, len(TEXT)), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
