import html
import re

import numpy as np
import pytest

from provenant.llm import pagetext
from provenant.llm.boosting import BoostedTrees

DIR = "/root/testdata/sf0.01"


def _article(page):
    """The blocks of the article element, read off by patterns, as the given pages are made."""
    found = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", found[1] if found else "")
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


@pytest.fixture(scope="module")
def trees(spark):
    return pagetext.fit(spark.read.parquet(f"{DIR}/pages.parquet"))


def test_given_pages(spark, trees):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r for r in pagetext.extract(pages, trees, ["page_id", "url"]).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == _article(r.html) and got[r.page_id].n_chars == len(_article(r.html))


def test_other_layouts(spark, trees):
    prose = "This is a sentence of the story, and it goes on for a while; then it ends here. " * 4
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
      <header class="site-header"><a href="/">Home</a> <a href="/x">News</a></header>
      <nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
      <div class="cookie-notice">We use cookies. <button>OK</button></div>
      <article class="post"><h1>A  &eacute;title &amp; more</h1><p>{prose}<p>{prose}<script>var x = "</p>";</script>
        <!-- <p>no</p> --><div class="ad">Buy now!</div><p>Last<br>one&nbsp;here.</p>
        <section id="comments"><p>{prose}</p></section></article>
      <aside><p>Related: <a href="/c">Three</a></p></aside>
      <form><input><p>Subscribe to our letter</p></form><footer>Copyright</footer></body></html>"""
    block = " ".join(prose.split())
    rows = [(1, page), (2, None), (3, ""), (4, "<p"), (5, "<!-- open <p>x</p>"), (6, page), (7, "<article>" + f"<p>{prose}</p>" * 3000 + "</article>"),
            (8, "<div>" * 3000 + prose), (9, '<p class="x>' * 50)]
    docs = spark.createDataFrame([(i, p, "x") for i, p in rows], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in pagetext.extract(docs, trees, ["page_id"]).collect()}
    assert got[1] == f"A étitle & more\n{block}\n{block}\nLast one here." == got[6]
    assert got[2] == got[3] == got[5] == ""
    assert got[7] == "\n".join([block] * 3000) and len(got) == len(rows)
    assert pagetext.extract(docs.limit(0), trees, ["page_id"]).count() == 0
    assert pagetext.extract(docs, pagetext.fit(docs.limit(0)), ["page_id"]).count() == len(rows)


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body><p>kept</p>",
    "<html><head><title>T</title><script>'<p>no</p>'</script><article><p>kept</p></article>",
    "<head><meta charset=x><title>T</title>kept",
    "<svg viewBox='0 0 1 1'/><p>kept</p>",
    "<svg><title>T</title><path/></svg><p>kept</p>",
    "<svg><p>kept</p>",
    "<video-player></video-player><p>kept</p>",
    "<button-group><p>kept</p></button-group>",
    "<select-box><p>kept</p></select-box>",
    "<!--><p>kept</p><!-- no -->",
    "<!---><p>kept</p><!-- no -->",
    "<!-- no --!><p>kept</p><!-- no -->",
    "<button><p>kept</p>",
    "<p>kept</p><script>no </scripts> <p>no</p>",
    "<p>kept</p><script data-x='>no'>no</script >",
    "<p>kept</p><title>no <p>no</p>",
])
def test_silent_elements_end_where_html_ends_them(page):
    assert [n.text for n in pagetext.parse(page) if n.tag == "text"] == ["kept"]


def test_many_silent_elements_without_end_take_linear_time():
    nodes = pagetext.parse("<button>a <video>b " * 100_000)
    assert len(nodes[-1].text) == 399_999


PROSE = "This is a sentence of the story, and it goes on for a while; then it ends here. " * 4
BLOCK = " ".join(PROSE.split())
STORY = f"<h1>Headline</h1><p>{PROSE}</p><p>{PROSE}</p>"
NAV = '<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>'
MENU = '<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul>'
FOOT = "<footer>Copyright</footer>"
LAYOUTS = {
    "a body named by its state": f'<body class="post has-comments sidebar-right">{NAV}<article>{STORY}</article>{FOOT}</body>',
    "an article named by its state": f'{NAV}<article class="post share-enabled">{STORY}</article>{FOOT}',
    "a wrapper with a part's name": f'{NAV}<div class="sidebar-left menu"><article>{STORY}</article></div>{FOOT}',
    "a form around the page": f'<form action="/x">{NAV}<article>{STORY}</article>{FOOT}</form>',
    "a form around a page without names": f'<form action="/x">{MENU}<div>{STORY}</div></form>',
    "a header in the article": f'<header><h1>Site</h1></header>{NAV}<article><header><h1>Headline</h1></header>{STORY[17:]}</article>{FOOT}',
    "comments longer than the article": f'{NAV}<article>{STORY}</article><div class="comments"><p>{PROSE * 20}</p></div>{FOOT}',
    "comments as articles": f'<article>{STORY}<section id="comments"><article class="comment"><p>{PROSE}</p></article></section></article>',
    "an article named by class": f'{NAV}<div id="content" class="main-content no-sidebar">{STORY}<div class="related-posts">{MENU}</div></div>{FOOT}',
    "a copyright line without names": f"{MENU}<div>{STORY}</div><p>Copyright 2021 Some Firm</p>",
    "no wrappers at all": f"{MENU}{STORY}<p>Copyright 2021 Some Firm. All rights reserved.</p>",
}


#: Three distinct pages teach the trees about names, but not enough about pages without any.
UNNAMED = ("a form around a page without names", "a copyright line without names", "no wrappers at all")


@pytest.mark.parametrize(("layout", "how"), [
    *((layout, "trees") for layout in LAYOUTS), *((layout, "few") for layout in LAYOUTS if layout not in UNNAMED)])
def test_layouts_keep_the_whole_article_and_nothing_else(request, layout, how):
    learnt = request.getfixturevalue(how).value
    nodes = pagetext.parse(f"<html>{LAYOUTS[layout]}</html>")
    got = pagetext.decode(nodes, pagetext.margins_of(learnt, pagetext.features(nodes)))
    assert got == ["Headline", BLOCK, BLOCK]


def test_links_alone_lists_and_bare_text_of_an_article_stay(trees):
    inner = f'<h1>Headline</h1><p>{PROSE}</p><p><a href="/q">A link alone</a></p>{MENU}<p>{PROSE}</p>Bare end of it.'
    want = ["Headline", BLOCK, "A link alone", "One", "Two", "Three", BLOCK, "Bare end of it."]
    nodes = pagetext.parse(f"<html><body>{NAV}<article>{inner}</article>{FOOT}</body></html>")
    assert pagetext.decode(nodes, pagetext.margins_of(trees.value, pagetext.features(nodes))) == want


@pytest.fixture(scope="module")
def few(spark):
    """Learnt from a table of many rows that are copies of three pages."""
    three = spark.read.parquet(f"{DIR}/pages.parquet").where("page_id < 3").select("html")
    return pagetext.fit(three.crossJoin(spark.range(4000).select()))


def test_a_table_of_copies_teaches_and_the_order_of_rows_does_not(spark, few, trees):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = pagetext.extract(pages.where("page_id < 3"), few, ["page_id"]).collect()
    want = {r.page_id: _article(r.html) for r in pages.where("page_id < 3").collect()}
    assert {r.page_id: r.text for r in got} == want and all(want.values())
    again = pagetext.fit(pages.union(pages).repartition(5)).value
    assert again.prior == trees.value.prior and again.trees == trees.value.trees


def test_pages_without_names_or_without_text_teach_too():
    unnamed = [f"<html><body>{MENU}<div><h1>Title {n}</h1><p>{PROSE}</p><p>{PROSE}{n}</p></div></body></html>" for n in range(30)]
    nodes = pagetext.parse(unnamed[0])
    assert BLOCK in pagetext.decode(nodes, pagetext.margins_of(pagetext.train(unnamed), pagetext.features(nodes)))
    assert pagetext.train([]) is None and pagetext.train(["<p></p>", ""]) is None
    assert BLOCK in pagetext.decode(nodes, pagetext.margins_of(None, pagetext.features(nodes)))


def test_decoding_takes_nothing_below_what_it_rejects():
    nodes = pagetext.parse(f"<div><p>one</p>{MENU}</div><div class='x'><p>{PROSE}</p><section><p>{PROSE}</p></section></div>")
    drawn = np.random.default_rng(3)
    for _ in range(200):
        margins = drawn.normal(0, 3, len(nodes))
        for node, margin in zip(nodes, margins):
            if margin < -4:
                below = {id(n) for n in pagetext._below(node)}
                lowered = np.where([id(n) in below or n is node for n in nodes], -50, margins)
                kept = pagetext.decode(nodes, lowered)
                assert len(kept) <= sum(n.tag == "text" and id(n) not in below for n in nodes)


def test_decoding_never_contradicts_ancestors():
    nodes = pagetext.parse("<div><p>one</p><ul><li>two</li></ul></div><div><p>three</p></div>")
    number = {n: k for k, n in enumerate(nodes)}
    rng = np.random.default_rng(2)
    for _ in range(50):
        margins = rng.normal(0, 2, len(nodes))
        texts = pagetext.decode(nodes, margins)

        def best(node):
            below = sum(max(0, best(c)) for c in node.children)
            return margins[number[node]] + below if node.tag == "text" or below > 0 else -1

        def chain(node):
            return node is None or (best(node) > 0 and chain(node.parent))
        # Every run that is worth it is kept, and bare text only where its element is.
        assert all(n.text in texts for n in nodes if n.tag == "text" and chain(n))
        assert all(chain(n.parent) for n in nodes if n.tag == "text" and n.text in texts)


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
