"""The small labelled table of operator 13: pages in outline, whose kept blocks begin with KEPT.

``{n}`` stands for n words of text and ``{an}`` for a link of n words. The outlines are of common kinds of pages (articles with
and without speaking elements and classes, lists, comments, notices, forms), written for this purpose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

KEPT = "\u00a7"

NAV = "<nav><ul><li>{a1}</li><li>{a2}</li><li>{a1}</li><li>{a1}</li></ul></nav>"
MENU = "<ul><li>{a1}<li>{a2}<li>{a1}<li>{a2}<li>{a1}</ul>"

OUTLINES = (
    NAV + "<article><h1>+{7}</h1><p>+{60}</p><p>+{45}</p><p>+{2}</p><p>+{80}</p></article><footer>{9}</footer>",
    NAV + '<div class="ad">{12}</div><article><h1>+{4}</h1><p>+{1}</p><p>+{3}</p><p>+{30}</p></article><footer>{4} {a1} {a2}</footer>',
    "<header>{a2} {5}</header><main><h1>+{9}</h1><p>+{25}</p><ul><li>+{6}<li>+{12}<li>+{4}</ul><p>+{50} {a3} {20}</p></main><aside><h3>{3}</h3><p>{40}</p></aside>",
    '<div id="header">{3}</div><div id="menu">' + MENU + '</div><div id="content"><h2>+{5}</h2><p>+{70}</p><p>+{8}</p></div><div id="sidebar"><h4>{2}</h4><p>{25}</p>' + MENU + "</div>",
    '<div class="cookie-notice"><p>{28}</p>{a1}</div><article><header><h1>+{6}</h1><p>+{4}</p></header><p>+{90}</p><blockquote>+{15}</blockquote><footer>{5}</footer></article>',
    NAV + '<article><h1>+{8}</h1><p>+{66}</p><div class="share">{a1} {a1} {a1}</div><p>+{33}</p><aside><p>{35}</p></aside><p>+{5}</p></article><section id="comments"><h3>{2}</h3><p>{55}</p><p>{21}</p><p>{3}</p></section>',
    '<article><h1>+{5}</h1><p>+{48}</p></article><div class="comments"><article class="comment"><p>{60}</p></article><article class="comment"><p>{9}</p></article></div>',
    "<form><p>{6}</p><p>{14}</p></form><main><p>+{52}</p><table><tr><td>+{2}<td>+{1}<tr><td>+{3}<td>+{1}</table><p>+{18}</p></main>",
    MENU + "<h1>+{6}</h1><p>+{64}</p><p>+{41}</p><p>+{57}</p><p>{2} {a2} {a2}</p>",
    "<div>{a2} {a1} {a3} {a1}</div><div>+{75}</div><div>+{38}</div><div>+{92}</div><div>{a3}</div><div>{a4}</div><div>{6}</div>",
    "<table><tr><td>{a1}<td>{a1}<td>{a2}</table><h2>+{4}</h2><p>+{55}</p><p>+{12}</p><p>+{61}</p><ul><li>{a6}<li>{a8}<li>{a5}<li>{a7}</ul><p>{5}</p>",
    "<p>{3}</p>" + MENU + "<h1>+{10}</h1><p>+{36} {a2} {20}</p><h2>+{3}</h2><p>+{44}</p><ul><li>+{9}<li>+{16}<li>+{11}</ul><p>+{49}</p><p>{a1} {a1} {a2}</p><p>{7}</p>",
    "<p>+{120}</p><p>+{85}</p>",
    "<p>+{22}</p><p>+{17}</p><p>+{31}</p>",
    "<h1>+{3}</h1><p>+{14}</p><p>+{26}</p>",
    MENU + "<ul><li>{a7} {2}<li>{a9} {3}<li>{a6} {2}<li>{a8} {1}</ul><div>{a1} {1} {a1}</div>",
    '<div class="post"><h2>+{6}</h2><div class="entry-content"><p>+{40}</p><p>+{2}</p><p>+{58}</p></div><div class="related-posts"><h3>{2}</h3><ul><li>{a6}<li>{a8}</ul></div><div class="newsletter"><p>{15}</p></div></div>',
    '<div class="banner"><p>{22}</p></div><div class="article-body"><p>+{65}</p><figure><figcaption>+{9}</figcaption></figure><p>+{3}</p><div class="promo"><p>{18}</p></div><p>+{47}</p></div><div class="footer"><p>{24}</p><p>{a1} {a2}</p></div>',
    '<div role="navigation">{a1} {a1}</div><div role="main"><h1>+{5}</h1><p>+{1}</p><p>+{28}</p><pre>+{19}</pre></div><div role="contentinfo"><p>{31}</p></div>',
    '<main><section><h2>+{3}</h2><p>+{20}</p></section><section><h2>+{2}</h2><p>+{6}</p><dl><dt>+{1}<dd>+{7}<dt>+{2}<dd>+{10}</dl></section><nav>{a2} {a2}</nav></main><dialog><p>{26}</p></dialog>',
    '<article><h1>+{4}</h1><p>+{a8}</p><p>+{12} {a9}</p><p>+{44}</p><ul><li>+{a4} {6}<li>+{a5} {3}</ul></article><div class="subscribe"><p>{19}</p></div>',
    '<div class="story"><p>+{5}</p><p>+{4}</p><p>+{72}</p><div class="advertisement"><p>{30}</p><p>{a2}</p></div><p>+{16}</p></div><div class="trending"><p>{8}</p><p>{45}</p></div>',
    '<header><h1>{3}</h1><p>{8}</p></header><div class="content"><div class="breadcrumbs">{a1} {a1} {2}</div><h1>+{7}</h1><p>+{34}</p><p>+{11}</p></div><div class="pagination">{a1} {a1}</div>',
    # Nothing speaks for a block but its words, links and neighbours.
    MENU + "<h1>+{5}</h1><p>+{44}</p><p>+{3}</p><p>+{62}</p><p>+{6}</p><p>+{51}</p><p>{4}</p>",
    "<div>{a1} {a1} {a2}</div><p>+{35} {a3} {16}</p><p>+{4}</p><p>+{48} {a2} {9} {a1} {12}</p><p>+{8}</p><p>+{29}</p><div>{a2} {a2}</div><div>{5}</div>",
    "<ul><li>{a1}<li>{a2}</ul><h2>+{4}</h2><p>+{58}</p><ul><li>+{4}<li>+{7}<li>+{3}<li>+{5}</ul><p>+{40} {a4}</p><ul><li>{a2}<li>{a1}<li>{a3}</ul>",
    "<div>{4}</div><div>{a2} {a1}</div><h1>+{8}</h1><div>+{30} {a2} {30}</div><div>+{2}</div><div>+{55}</div><div>{a6}</div><div>{a5}</div><div>{a7}</div><div>{3} {a1}</div>",
    "<p>+{18} {a1} {5}</p><p>+{27}</p><p>+{5}</p><p>+{39} {a3}</p><p>+{24}</p>",
    "<h1>+{6}</h1><p>+{7}</p><p>+{33}</p><h2>+{2}</h2><p>+{21} {a1} {14}</p><p>+{9}</p><h2>+{4}</h2><p>+{46}</p>",
    MENU + "<p>+{42}</p><p>+{11}</p><p>+{70} {a6} {25}</p><h3>+{3}</h3><p>+{15}</p><p>{a3} {1} {a3}</p><p>{a2}</p><p>{6}</p>",
    "<ul><li>{a2} {1}<li>{a3} {2}<li>{a2}</ul><h2>{2}</h2><ul><li>{a5}<li>{a6}<li>{a4}</ul><h2>{2}</h2><ul><li>{a7}<li>{a5}</ul><p>{8}</p>",
    "<table><tr><td>{a1}<td>{a2}</table><p>+{53}</p><table><tr><td>+{1}<td>+{2}<td>+{1}<tr><td>+{2}<td>+{1}<td>+{3}</table><p>+{37}</p><p>{3} {a2}</p>",
    # Lists of links inside an article's element are menus all the same.
    "<main><ul><li>{a3}<li>{a4}<li>{a3}<li>{a2}</ul><h1>+{5}</h1><p>+{43}</p><p>+{7} {a9}</p><p>+{36}</p><ul><li>{a1}<li>{a1}<li>{a1}</ul></main>",
    '<div id="main"><div>{a1} {a1} {a2} {a1}</div><h1>+{6}</h1><p>+{1}</p><p>+{24} {a2} {3}</p><p>+{61}</p><ul><li>{a7}<li>{a6}<li>{a8}</ul></div>',
    '<article><ul><li>{a2}<li>{a1}<li>{a2}</ul><p>+{38}</p><p>+{a3} {4}</p><p>+{2} {a1}</p><ol><li>+{8}<li>+{6} {a2}<li>+{5}</ol><p>+{20}</p></article>',
    # Short articles, and such that end the page.
    NAV + "<article><h1>+{1}</h1><p>+{1}</p></article>",
    NAV + "<article><h1>+{2}</h1><p>+{30}</p><p>+{3}</p></article>",
    '<div class="ad">{1}</div><div class="content"><p>+{9}</p><p>+{2}</p></div><div>{1}</div>',
    "<div>{a1}</div><main><p>+{5}</p></main>",
    "<article><p>+{12}</p><p>+{1}</p><p>+{4}</p></article><div>{1}</div><div>{a1}</div>",
    '<article><h2>+{3}</h2><p>+{26}</p><div><p>+{2}</p><p>+{6}</p></div></article><p>{1}</p>',
    '<div id="content"><h1>+{1}</h1><p>+{10}</p></div>',
    "<article><h1>+{5}</h1><p>+{31}</p><p>+{4}</p><p>+{1}</p></article>" + MENU,
    "<main><h2>+{3}</h2><p>+{17}</p><p>+{2}</p></main><div>{a3} {a2}</div><div>{a6}</div>",
    '<div class="post"><p>+{40}</p><p>+{6}</p></div><div>{a5}</div>' + NAV,
    "<article><p>+{27}</p><p>+{2}</p></article><p>{a3}</p><p>{a1}</p>",
    '<div>{a1} {a1}</div><div class="entry"><p>+{4}</p><p>+{1}</p></div>' + MENU,
    "<article><h1>+{1}</h1><p>+{6}</p></article><ul><li>{a2}<li>{a1}</ul>",
    '<div class="post"><p>+{1}</p><p>+{12}</p></div><div>{a3}</div>',
    '<div id="content"><p>+{20}</p><p>+{1}</p><p>+{34}</p><p>+{a1} {4}</p></div><div>{a2} {a2}</div>',
    '<article><p>+{1}</p><p>+{50}</p></article><div class="share">{a2}</div>',
    NAV + "<article><p>+{70}</p></article>" + MENU,
    NAV + "<article><h1>+{6}</h1></article><div>{a2}</div>",
    NAV + '<div class="entry"><p>+{3}</p></div>' + MENU,
    MENU + "<p>+{80}</p>" + MENU,
    '<article><p>+{3}</p></article><p>{a2}</p><p>{a4}</p><p>{1}</p>',
    '<section class="comments-area"><article><p>{47}</p><p>{a1} {12}</p></article></section><div class="content">+{33}<p>+{28}</p></div>',
)


def filled(outline: str) -> str:
    """An outline with its words put in."""
    number = iter(range(10**9))

    def words(mark: str, n: int) -> str:  # the mark is part of the first word, so that it counts as none
        return KEPT * bool(mark) + " ".join(f"w{next(number)}" for _ in range(n))

    def put(m: re.Match) -> str:
        text = words(m[1], int(m[3]))
        return f'<a href="#">{text}</a>' if m[2] else text

    return re.sub(r"(\+?)\{(a?)(\d+)\}", put, outline)


def pages() -> Iterator[str]:
    return map(filled, OUTLINES)
