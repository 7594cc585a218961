"""Main text of pages: the distribution decides, marks only shift it."""

import re

import pytest

from relspark.llm.html_extract import extract, main_text

LONG = " ".join(f"word{i}" for i in range(60))
MORE = " ".join(f"more{i}" for i in range(70))
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News of today</a></ul></nav>"
FOOT = "<footer>All rights are with the owner of this page.</footer>"

CASES = {
    "words of a class do not empty the text": (f"<div class='post-header'><h1>Title</h1></div><div class='side-story'><p>{LONG}</p></div>", f"Title\n{LONG}"),
    "nor inside an article": (f"<article><h1>T</h1><div class='share-price'><p>{LONG}</p></div></article>", f"T\n{LONG}"),
    "a header inside main is the text's": (f"<main><header><h1>T</h1></header><p>{LONG}</p></main>", f"T\n{LONG}"),
    "a page inside a form": (f"<form>{NAV}<div><h1>T</h1><p>{LONG}</p></div></form>{FOOT}", f"T\n{LONG}"),
    "no article": (f"{NAV}<div class=ad>Buy now, only today.</div><h1>Head</h1><p>{LONG}<p>Short.<p>{MORE}{FOOT}", f"Head\n{LONG}\nShort.\n{MORE}"),
    "a teaser in an article beside the text": (f"{NAV}<div><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></div>{FOOT}<article><p>Teaser.</p></article>", f"Head\n{LONG}\n{MORE}"),
    "several articles": (f"{NAV}<article><h2>One</h2><p>{LONG}</article><article><h2>Two</h2><p>{MORE}</article>{FOOT}", f"One\n{LONG}\nTwo\n{MORE}"),
    "a far smaller article is a teaser": (f"<article><h1>One</h1><p>{LONG}<p>{MORE}</article><article><h2>Also read</h2></article>", f"One\n{LONG}\n{MORE}"),
    "reader comments": (f"<article><h1>One</h1><p>{LONG}</p><section id=comments><article class=comment><p>First! {MORE[:90]}</article></section></article>", f"One\n{LONG}"),
    "links in a paragraph": (f"<article><p><a href=x>{LONG}</a></p><p>{MORE} <a href=y>here</a></p></article>", f"{LONG}\n{MORE} here"),
    "a short article between louder furniture": (f"<title>Tiny</title>{NAV}<div class=ad>{LONG[:150]}</div><article><h1>Tiny</h1><p>Few words.</article>{FOOT}", "Tiny\nFew words."),
    "hidden text": (f"<div hidden><p>{MORE}</p></div><div style='display: none'>{MORE}</div><p>{LONG}</p>", LONG),
    "unclosed and crossed tags": (f"<div><b><article><h1>T<p>{LONG}<i></b><p>Next <em>one</article></div></i>{FOOT}", f"T\n{LONG}\nNext one"),
    "an attribute with a sign": (f"<p title='a > b' data-x=\"<nav>\">{LONG}</p>", LONG),
    "character references": (f"<p>{LONG} &amp; &lt;p&gt; &eacute; &#x1F600; &nbsp; x</p>", f"{LONG} & <p> é 😀 x"),
    "an unclosed comment": (f"<p>{LONG}</p><!-- {MORE}", LONG),
    "nothing": ("<html><body></body></html>", ""),
    "only furniture": (NAV, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert main_text(page) == want


def article(page: str) -> str:
    import html

    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inside)]
    return "\n".join(b for b in blocks if b)


def test_all_pages_with_and_without_marks(spark):
    """The article's own text, also where the element is renamed, every class name scrambled, or the title gone."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect() if r.html]
    for page in pages:
        want = article(page)
        assert main_text(page) == want
        plain = re.sub('class="[^"]*"', 'class="q7"', page.replace("<article>", "<div class=z>").replace("</article>", "</div>"))
        assert main_text(plain) == want


def test_extract_handles_any_row(spark):
    rows = [(1, None, None), (None, "u", f"<p>{LONG}</p>"), (1, "u", ""), (1, "u", "<p>" + "x " * 400_000 + "</p>"), (2, "u", "<div " * 20_000), (2, "u", "</p>" * 20_000), (3, "u", "<p>a\x00b" + LONG)]
    d = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    got = extract(d).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got][:3] == ["", LONG, ""] and got[3].n_chars == 799_999
    assert extract(d.limit(0)).count() == 0
