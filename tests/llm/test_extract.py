import html as entities
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from fogbank.llm import extract, labelled

BLOCKISH = set(extract.BLOCKS.split())


class Slow(HTMLParser):
    """Blocks by the standard library's parser: text, words, linked words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.link, self.skip = [], [], False, 0

    def cut(self):
        text = " ".join("".join(t for t, _ in self.now).split())
        if text:
            self.out.append((text, len(text.split()), sum(len(t.split()) for t, k in self.now if k)))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "button"):
            self.skip += 1
        elif tag in BLOCKISH:
            self.cut()
        elif tag == "br":
            self.now.append((" ", self.link))
        elif tag == "a":
            self.link = True

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "button"):
            self.skip -= 1
        elif tag in BLOCKISH:
            self.cut()
            self.link = False
        elif tag == "a":
            self.link = False

    def handle_data(self, data):
        if not self.skip:
            self.now.append((data, self.link))


def slow_blocks(page):
    p = Slow()
    p.feed(page)
    p.close()
    p.cut()
    return p.out


#: Layouts that the labelled table doesn't have: what an article's page may look like, with {main} where its text is.
LAYOUTS = (
    """<!doctype html><html><head><title>T {x}</title><style>p{{a:b}}</style><meta name=x></head><body class="home no-sidebar"><header class="site-header"><div class=logo><a href=/>{x}</a></div>
    <nav class=main-nav><ul><li><a href=a>{x}</a><li><a href=b>{x}</a></ul></nav></header><div class="cookie-banner" role=alert><p>{long}</p><button>OK</button></div><main id=main>
    <article itemprop="articleBody">{main}<aside class=related><h3>{x}</h3><ul><li><a href=c>{long}</a></ul></aside></article>
    <section class="comments-area"><h2>{x}</h2><ol class=commentlist><li><article><p>{long}</p></article></li></ol><form><label>{x}</label><textarea>{long}</textarea></form></section></main>
    <footer><p>&copy; {x}</p></footer><script>document.write("<p>{long}</p>")</script></body></html>""",
    """<html><body><div id="topbar"><a href=1>{x}</a> | <a href=2>{x}</a></div><div id="wrapper"><div class="leftmenu sidebar"><ul><li><a href=3>{x}</a></li><li><a href=4>{x}</a></li></ul><p>{long}</p></div>
    <div class="content">{main}</div><div class="adsense"><!-- <p>{long}</p> --><p>{long}</p></div></div><div id=footer>{x} <a href=5>{x}</a></div>""",
    """<body><form id=f action=s><input name=q><select><option>{x}<option>{x}</select></form><div class="post-content">{main}<div class="social-share"><a href=1>{x}</a></div></div>
    <div class="newsletter-signup"><h4>{x}</h4><p>{long}</p></div><div class="userComments"><p>{long}</p><p>{x}</p></div><div hidden><p>{long}</p></div><div style="display: none">{long}</div>""",
)


def dressed(rnd, make, n):
    """n pages: (html, the text that is to come out)."""
    out = []
    for i in range(n):
        paragraphs = [make(1000 * i + k, rnd.choice((1, 2, 8, 30, 60)), rnd.choice(("en", "de", "fr"))) for k in range(rnd.randrange(2, 9))]
        paragraphs[-1] += " AT&T <3 \u00a9 \"q\""
        body = "".join((f"<h1 class=title>{entities.escape(p)}</h1>" if k == 0 else f"<p>{entities.escape(p)}" + rnd.choice(("</p>", "", "<br></p>\n  "))) for k, p in enumerate(paragraphs))
        layout = LAYOUTS[i % len(LAYOUTS)]
        out.append((layout.format(x=make(i + 7, 2), long=make(i + 9, 35), main=body), "\n".join(" ".join(p.split()) for p in paragraphs)))
    return out


def test_blocks_equal_the_standard_parser(prose):
    rnd = random.Random(5)
    pages = [p for p, _ in dressed(rnd, prose, 30)] + list(labelled.pages())
    pages += ["", "just text", "a < b & c > d &amp;amp; &lt;p&gt; &notanentity; &#65;&#x42;", "<p>one<p>two <b>three<br>four</p> five", "<div><a href='x>y'>in a</a> link</div><A HREF=x>up</A>", "<p>un<!-- x > y -->split</p>"]
    for page in pages:
        if "<form" in page or "hidden" in page:
            continue  # fields that the plain parser reads as text
        assert [b[:3] for b in extract.Page().read(page)] == slow_blocks(page), page[:80]


def test_main_text_of_other_layouts(spark, prose):
    rows = dressed(random.Random(8), prose, 60)
    df = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, (h, _) in enumerate(rows)], "page_id long, url string, html string, text string, blocks int").repartition(3)
    got = {r.page_id: r.text for r in extract.main_text(df).collect()}
    assert [got[i] for i in range(len(rows))] == [t for _, t in rows]


def test_spark_applies_the_tree_that_was_grown(spark, prose):
    pages = [p for p, _ in dressed(random.Random(2), prose, 12)] + list(labelled.pages())
    rnd = np.random.default_rng(1)
    x, y = rnd.random((300, len(extract.FEATURES))) * 20, rnd.integers(0, 2, 300)
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    for tree in (extract.fit(), extract.grow(x, y), extract.Node(True)):
        got = {r.page_id: r.text for r in extract.main_text(df, tree).collect()}
        for i, page in enumerate(pages):
            blocks = extract.Page().read(page)
            assert got[i] == "\n".join(b[0] for b, f in zip(blocks, extract.features_of(blocks), strict=True) if extract.decide(tree, f))


def test_tree_splits_like_a_plain_search():
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 1] > 2) & (x[:, 0] <= 3)).astype(int)
    tree = extract.grow(x, y)
    assert all(extract.decide(tree, r) == bool(k) for r, k in zip(x, y, strict=True))

    def impurity(v):
        return len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0

    best = min((impurity(y[x[:, f] <= b]) + impurity(y[x[:, f] > b]), f, b) for f in range(3) for b in np.arange(0.5, 5.5))
    assert (tree.feature, tree.bar) == best[1:]


def test_left_out_pages_of_the_labelled_table_are_judged_well():
    pages = [extract.Page().read(p) for p in labelled.pages()]
    x = [extract.features_of(b) for b in pages]
    y = [np.array([b[0].startswith(labelled.KEPT) for b in p], dtype=int) for p in pages]
    wrong = 0
    for i in range(len(pages)):
        rest = [k for k in range(len(pages)) if k != i]
        tree = extract.grow(np.concatenate([x[k] for k in rest]), np.concatenate([y[k] for k in rest]))
        wrong += sum(extract.decide(tree, r) != bool(k) for r, k in zip(x[i], y[i], strict=True))
    assert wrong <= 0.04 * sum(map(len, y))


def test_links_and_neighbours_decide_where_nothing_else_speaks():
    """The same words: as a menu between links they go, as a paragraph between paragraphs they stay."""
    tree = extract.fit()
    text = "<p>" + "word " * 40 + "</p>"
    short = "<p>three words here</p>"
    links = "<ul><li><a href=x>one</a><li><a href=y>two</a><li><a href=z>three</a></ul>"

    def judged(page):
        blocks = extract.Page().read(page)
        return [b[0][:5] for b, f in zip(blocks, extract.features_of(blocks), strict=True) if extract.decide(tree, f)]

    assert judged(links + text + short + text + links) == ["word ", "three", "word "]
    assert judged(links + short + links + text + text) == ["word ", "word "]


def test_odd_pages(spark):
    rows = [(1, "a", None), (2, "b", ""), (3, None, "<p"), (4, "c", "<p>" + "x " * 300_000 + "</p>"), (4, "c", "<p>" + "x " * 300_000 + "</p>"), (None, "d", "<article>hi</article>"), (5, "e", "<!--"), (6, "f", "<script>never closed <p>x</p>"), (7, "g", "<nav>only</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract.main_text(df).collect()
    assert sorted((str(r.page_id), len(r.text)) for r in got) == [("1", 0), ("2", 0), ("3", 0), ("4", 599_999), ("4", 599_999), ("5", 0), ("6", 0), ("7", 0), ("None", 2)]
    assert extract.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["<", "<p ", "<a '", '<a "', "<!--", "<button>", "</div>", "<li>", "<script>", "<p><b>", "<div>", "<!-- -", "<p class='", "&"])
def test_time_grows_with_the_page(bad):
    import time

    def took(n):
        began = time.perf_counter()
        extract.Page().read(bad * n)
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 30 * max(took(8_000), 0.01)
