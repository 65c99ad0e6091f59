import html
import re

import pytest

from draftspark.llm import main_text as M

from .conftest import SF


def test_pages_give_their_articles(llm):
    pages = llm.read.parquet(f"{SF}/pages.parquet")
    for r in M.extract(pages).join(pages.select("page_id", "html"), M.F.col("row.page_id") == M.F.col("page_id")).select("text", "html").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


CASES = [
    ('<html><body><header><h1>Site</h1></header><div id="menu"><ul><li><a href=x>Home</a><li><a>News</a></ul></div><div class="content"><h2>Title of it</h2>'
     '<p>First paragraph of the text &amp; more text, which is long enough to count as text.</p><p>Short.</p><div class="share-buttons">Share!</div>'
     '<p>Second a &lt; b with <a href="x">a link</a> and<br>a break.</p></div><div class="comments"><p>Great post, I like it a lot, very very very very very very much!</p></div>'
     '<div id="footer">(c) 2020 all rights reserved by someone somewhere over the rainbow</div></body>',
     "Title of it\n\nFirst paragraph of the text & more text, which is long enough to count as text.\n\nShort.\n\nSecond a < b with a link and a break."),
    ('<body><nav><a>x</a><article><h1>T</h1><p>Of.<p>If a < b & c > d, ok<aside>side</aside><p>more <span class="ad">BUY</span>text<form>name <input></form>'
     '<section class="comments"><article><p>nice!</p></article></section></article><footer>f</footer>', "T\n\nOf.\n\nIf a < b & c > d, ok\n\nmore text"),
    ("", ""), (None, ""), ("<p>x", "x"), ("<!-- a --><script>if(a<b){\"</p>\"}</script><p>only&nbsp; text</p>", "only text"), ("<article></article>", ""), ("<", "<"),
    ("<article><p>a<!-- never closed <p>b", "a"), ("plain words only", "plain words only"),
    ("<main><div class='cookie-notice'>We use cookies</div><p>Text &eacute;&#x41;</p><ul><li>one</li><li>two</li></ul></main>", "Text éA\n\none\n\ntwo"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert M.main_text(page or "") == text


LONG = "A long paragraph of the text that has more than eighty characters, so that any window with it surges."
AD = "<div class='ad'><p>Buy<p>this<p>now</div>"
WHOLE = [
    (f"<body><h1>The title</h1><p>By A. Writer</p><p>3 May 2020</p><p>{LONG}</p></body>", f"The title\n\nBy A. Writer\n\n3 May 2020\n\n{LONG}"),
    (f"<body><div><p>{LONG}</p>{AD}<p>Short one.</p><p>Short two.</p>{AD}<p>Short three.</p></div></body>", f"{LONG}\n\nShort one.\n\nShort two.\n\nShort three."),
    (f"<body><p>Before.</p>{AD}<p>{LONG}</p>{AD}<p>Between.</p>{AD}<p>{LONG}</p></body>", f"Before.\n\n{LONG}\n\nBetween.\n\n{LONG}"),
    (f"<body><div>{LONG}</div>{AD}<div>One.</div>{AD}<div>Two.</div></body>", f"{LONG}\n\nOne.\n\nTwo."),
    (f"<body><div><p>Few words.</p>{AD}<p>Some more words.</p></div></body>", "Few words.\n\nSome more words."),
    ("<article><p>Text.</p><ul><li><a href=a>Source A</a><li><a href=b>Source B</a><li><a href=c>Source C</a></ul></article>", "Text.\n\nSource A\n\nSource B\n\nSource C"),
    (f"<html class='has-comments'><body class='single comments-open'><p>{LONG}</p><div class='comments'><p>Nice!</p></div></body>", LONG),
    (f"<body><div><a href=a>A</a></div><div><a href=b>B</a></div><div><a href=c>C</a></div><p>{LONG}</p></body>", LONG),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{AD}<p>Beside.</p>{AD}<p>Far away.</p></body>", f"{LONG}\n\n{LONG}\n\nBeside."),
]


@pytest.mark.parametrize("page,text", WHOLE)
def test_whole_texts(page, text):
    assert M.main_text(page) == text


THREE, TEXT = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>", f"{LONG}\n\n{LONG}\n\n{LONG}"
SIDE = "<div class='sidebar'><p>" + "Something that is told beside the text, at some length. " * 4 + "</p></div>"
WRAPPERS = [
    (f"<body><div class='layout has-sidebar'>{THREE}</div></body>", TEXT),
    (f"<body><div id='main' class='with-banner'>{THREE}</div></body>", TEXT),
    (f"<body><main id='main' class='with-banner'>{THREE}</main></body>", TEXT),
    (f"<body><div class='content page-header-fixed'>{THREE}</div></body>", TEXT),
    (f"<article><div class='article-social-content'>{THREE}</div></article>", TEXT),
    (f"<body><div class='layout has-sidebar'>{SIDE}<div class='text with-ads'>{THREE}</div></div></body>", TEXT),
    (f"<body><div class='layout has-sidebar'><div>{THREE}</div>{SIDE}</div></body>", TEXT),
    (f"<body><div>{THREE}</div>{SIDE}<div class='cookie-notice'><p>{LONG}</p></div></body>", TEXT),
    (f"<body><div class='cookie-notice'><p>{LONG}</p></div></body>", ""),
    ("<body><div class='menu'>" + f"<p><a href=x>{LONG}</a></p>" * 9 + "</div><p>Text.</p></body>", "Text."),
    (f"<body><div role='navigation'>{THREE}</div><p>Text.</p></body>", "Text."),
    (f"<body><div class='comments'>{THREE}</div><p>Text.</p></body>", "Text."),
]


@pytest.mark.parametrize("page,text", WRAPPERS)
def test_a_word_does_not_outweigh_the_text(page, text):
    assert M.main_text(page) == text


def test_many_named_elements():
    """Very deep and very many ones neither take long nor much room."""
    assert M.main_text("<div class='has-ads'>" * 20_000 + THREE) == TEXT
    assert M.main_text("<body><p>Text.</p>" + f"<div class='menu'><a href=x>{THREE}</a></div>" * 4000) == "Text."


def test_odd_rows(llm):
    rows = [(1, "u", p, "t", "r") for p, _ in CASES] + [(2, None, "<p>" + "long text " * 50_000 + "</p>", None, None), (None, None, "<p>" * 20_000, None, None)]
    df = llm.createDataFrame(rows, "page_id long, url string, html string, text string, row string")
    out = M.extract(df)
    assert out.count() == len(rows) and out.columns == ["row", "text"]
    assert {r["text"] for r in out.where("row.page_id = 1").collect()} == {t for _, t in CASES}
    assert M.extract(df.limit(0)).count() == 0
