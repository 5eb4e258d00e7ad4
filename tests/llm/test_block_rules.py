"""Pages with known main text."""

import re

import pytest

from tallyfield.llm import block_rules as B
from tallyfield.llm import queries

LONG = "The first paragraph of the story is about a man and the sea, and it is long enough to be decided on its own."
MORE = "In the second part of the text they are on the way to the harbour with all that is left for them to carry."
RUSSIAN = "Первый абзац рассказывает о человеке и море, и он достаточно длинный, чтобы о нём можно было судить без других абзацев страницы."
CHINESE = "第一段讲述了一个人与大海的故事,它足够长,可以单独判断。" * 4
POLISH = "Pierwszy akapit opowiada o rybaku i morzu; jest wystarczająco długi, by dało się go ocenić bez pozostałych akapitów strony."

PAGES = [
    (f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>{LONG}<p>Short.</article><footer>&copy; x</footer>",
     f"A & B\n{LONG}\nShort."),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><div class='ad'>{LONG}</div>"
     f"<article><p>{LONG}<br>{MORE}</p></article></body></html>", f"{LONG} {MORE}"),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><aside>{MORE}</aside><form>{MORE}<input></form><section id=comments><p>{MORE}</p></section></article>",
     f"Title\n{LONG}"),
    (f"<header><h2>Site</h2></header><main><p>{LONG}</p><p>Ok.</p></main><div class='cookie-notice'>{MORE}</div>", f"{LONG}\nOk."),
    (f"<div id=nav-bar><a href=1>One</a> <a href=2>Two</a></div><div><p>{LONG}</p><p>Short one.</p><p>{MORE}</p></div><div><a href=3>More links to read</a></div>",
     f"{LONG}\nShort one.\n{MORE}"),
    (f"<article><p>{LONG}</p><p>a &lt; b &#233;&nbsp;x   y\n z</p><!-- <p>no</p> --><p>5 < 6 and 7 > 2</p><p>cut <b>off", f"{LONG}\na < b é x y z\n5 < 6 and 7 > 2\ncut off"),
    (f"<article><p>Es%%% de### la***</p><p>{'zz%%% ' * 60}</p><ul><li>item one</li><li>item two</li></ul></article>",
     f"Es%%% de### la***\n{('zz%%% ' * 60).strip()}\nitem one\nitem two"),
    # names inside an article that only sound like a part of the page
    (f"<article><h2 id='related-work'>Related work</h2><p>{LONG}</p><h2 id=social-impact>Impact</h2><section id='related-work'><p>{MORE}</p></section>"
     f"<p class='navy'>{LONG}</p><p class='search-results-discussion'>{MORE}</p><div class='side-effects'>{LONG}</div></article>",
     f"Related work\n{LONG}\nImpact\n{MORE}\n{LONG}\n{MORE}\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='related-posts'>{MORE}</div><div id='adSlot-3'>{MORE}</div><div class='x post-comments'>{MORE}</div>"
     f"<ul class='social share-buttons'><li>{MORE}</ul></article>", LONG),
    # comments of readers as articles, inside and after
    (f"<article><p>{LONG}</p><article class='comment'><p>{MORE}</p></article></article><article class='comment reply'>{MORE}</article>", LONG),
    (f"<main><article class='post'><p>{LONG}</p></article><section class=comments><article>{MORE}</article></section></main>", LONG),
    # linked cells and lists of links in an article
    (f"<article><p>{LONG}</p><table><tr><td><a href=b>Berlin</a></td><td>3.6 million</td></tr></table><ul><li><a href=x>One thing</a></li>"
     f"<li><a href=y>Another</a></li></ul></article>", f"{LONG}\nBerlin\n3.6 million\nOne thing\nAnother"),
    # languages without a list of stop words, without an article
    (f"<div class=menu><a href=x>Главная</a></div><div><p>{RUSSIAN}</p><p>Кратко.</p></div><div class='cookie-banner'>{LONG}</div>", f"{RUSSIAN}\nКратко."),
    (f"<div><a href=x>首页</a></div><div><p>{CHINESE}</p></div>", CHINESE),
    (f"<div><p>{POLISH}</p></div><div><a href=1>Czytaj dalej o tym wszystkim</a></div>", POLISH),
    (f"<div><p>{RUSSIAN}</p><p>{LONG}</p></div>", f"{RUSSIAN}\n{LONG}"),
    ("", ""), ("   ", ""), ("<p>", ""), ("<<<>>><a", None), ("<article></article>", ""), ("<nav>" + LONG, ""),
    ("<script>" + LONG, ""), ("<p a='>'>" + LONG, LONG), ("<P CLASS=ads>" + LONG + "</P><P>" + MORE, MORE),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages(k):
    page, want = PAGES[k]
    got = B.main_text(page)
    assert want is None or got == want


def test_rows(spark):
    rows = [(i, f"u{i}", p, 1) for i, (p, _) in enumerate(PAGES)] + [(None, None, None, 2), (0, "u0", PAGES[0][0], 1), (99, "u", "x" * 300_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = B.extract(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] is None] == [""]
    assert B.extract(df.limit(0)).collect() == []


def test_query(spark, data):
    """The given pages keep their text in one article of headings and unclosed paragraphs."""
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op9_block_rules(spark, data).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"</?(?:b|br)>", " ", body))
        lines = [" ".join(html.unescape(x).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in lines if x)
