import html
import re

import pytest

from tidemark.llm import html_text, queries

SF = "/root/testdata/sf0.01"


def test_query_against_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op7_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


LONG = "This is a paragraph of the article, with several clauses; it goes on for a while, and then ends."
PAGES = {
    "sidebar": f'<body><div id="content"><h2>Head</h2><p>{LONG}</p><p>Short.</p><ul><li>one<li>two</ul></div><div class="sidebar"><p>{LONG}</p></div><footer>foot</footer>',
    "comments": f'<main><h2>Head</h2><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><section class="comments"><p>{LONG}</p></section></main>',
    "notices": f'<header><h1>Site</h1></header><div class="cookie-notice">{LONG}</div><article><h2>Head</h2><p>{LONG}<p>Short.<ul><li>one<li>two</ul><aside>{LONG}</aside><form><p>{LONG}</p></form></article><div role="complementary"><p>{LONG}</p></div>',
    "broken": f'<nav><a href=x>{LONG}</nav><article><h2>Head<p><b>{LONG}<br></p><script>x = "</p>" + "<p>no"</script><p>Short.<ul><li>one</li><li>two<!-- <p>no -->',
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert html_text.main_text(PAGES[name]) == "\n\n".join(["Head", LONG, "Short.", "one", "two"])


def test_references_and_white_space():
    assert html_text.main_text("<p>a &amp;&lt;b&nbsp;&#233;  c\n\td<br>e</p>") == "a &<b é c d e"


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (3, "plain", "x"), (4, "<nav>menu</nav>", "x")], "id long, html string, text string")
    assert sorted((r.id, r.text) for r in html_text.extract(rows).collect()) == [(1, ""), (2, ""), (3, "plain"), (3, "plain"), (4, "")]
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<a '" * 50_000, "<li>" * 50_000, "<b><p>" * 30_000, "<!--" * 50_000, "<p>word " * 50_000])
def test_odd_pages_end(page):
    html_text.main_text(page)


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(20_000)) + "</article>"
    text = html_text.main_text(page)
    assert text.count("\n\n") == 19_999 and text.endswith("Paragraph 19999, with text.")


def test_ratios_decide_beside_an_article_and_in_it():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    links = "".join(f"<li><a href=x>Another page {i}</a></li>" for i in range(8))
    text = "\n\n".join(f"{LONG} {i}" for i in range(6))
    assert html_text.main_text(f"<main><h2>Head</h2>{body}<div><ul>{links}</ul></div></main>") == f"Head\n\n{text}"
    assert html_text.main_text(f"<div><div>{body}</div></div><article><h3><a href=x>Teaser</a></h3><p>More.</p></article>").startswith(text)
    assert html_text.main_text(f"<article><div><h2>Head</h2></div><section>{body}</section><section><ul><li>one<li>two</ul></section></article>") == f"Head\n\n{text}\n\none\n\ntwo"


@pytest.mark.parametrize("name", ["container has-sidebar", "content-with-sidebar", "no-sidebar", "post-12 post tag-politics", "wrapper navbar-fixed", "layout sidebar"])
def test_names_of_what_holds_the_page(name):
    for page in (f'<div class="{name}"><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><footer>foot</footer>', f'<div class="{name}"><article><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></article></div>'):
        assert html_text.main_text(page) == f"Head\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("name", ["related-work", "chapter legal"])
def test_names_of_sections_of_an_article(name):
    assert html_text.main_text(f'<article><p>{LONG}</p><p>{LONG}</p><section class="{name}"><h2>Head</h2><p>{LONG}</p></section></article>') == f"{LONG}\n\n{LONG}\n\nHead\n\n{LONG}"


@pytest.mark.parametrize("name", ["sidebar-left", "comment-list", "footer-inner", "related-posts", "site-header", "main-nav", "ad-slot-3", "skip-link"])
def test_names_of_boilerplate(name):
    assert html_text.main_text(f'<div><p>{LONG}</p><p>{LONG}</p></div><div class="{name}"><p>{LONG}</p></div>') == f"{LONG}\n\n{LONG}"


def test_only_whole_attributes_name_an_element():
    for given in ('title="the hidden garden"', 'data-id="menu"', "data-x='class=sidebar'", 'aria-label="id=footer"', "title='role=navigation hidden'", "data-hidden"):
        assert html_text.main_text(f"<article><p>{LONG}</p><div {given}><p>{LONG} again</p></div></article>") == f"{LONG}\n\n{LONG} again", given
    for given in ("hidden", 'CLASS="sidebar"', "id=footer", "role = 'navigation'", "aria-hidden=true", 'style="display: none"'):
        assert html_text.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div {given}><p>{LONG} again</p></div>") == f"{LONG}\n\n{LONG}", given


@pytest.mark.parametrize("name", ["side-effects", "related-work", "notice", "comments", "menu", "popular-search"])
def test_ids_made_from_headings(name):
    for tag in ("h2", "p", "li"):
        assert html_text.main_text(f"<article><p>{LONG}</p><{tag} id={name}>Title</{tag}><p>{LONG}</p></article>") == f"{LONG}\n\nTitle\n\n{LONG}"


def test_formulas_drawings_and_stand_ins():
    assert html_text.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be, and so on.</p></article>") == "Let x=1 be, and so on."
    assert html_text.main_text("<article><p>See <svg viewBox='0 0 1 1'><title>icon</title><path d='M0'/><text>here</text></svg>, then go.</p></article>") == "See here, then go."
    assert html_text.main_text(f"<article><p>{LONG}</p><object data=x><p>Instead, this text.</p></object><noscript><p>Or this text.</p></noscript></article>") == f"{LONG}\n\nInstead, this text.\n\nOr this text."
    assert html_text.main_text(f"<noscript>Please switch scripts on, as this page needs them.</noscript><div><p>{LONG}</p></div>") == LONG


def test_ratios_decide(monkeypatch):
    """With the ratios taken away, link lists inside and teasers outside are not told from text."""
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    teasers = "".join("<div><span>More news</span></div>" for _ in range(6))
    page = f"<body><section>{teasers}</section><section>{body}</section></body>"
    text = "\n\n".join(f"{LONG} {i}" for i in range(6))
    assert html_text.main_text(page) == text
    monkeypatch.setattr(html_text, "SHARE", 0.0)
    assert html_text.main_text(page) != text


def test_pages_whose_article_has_no_name(spark):
    """The table's pages with the article element made a plain one."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    wrong = 0
    for r in pages:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inside)]
        wrong += html_text.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) != "\n\n".join(x for x in parts if x)
    assert wrong <= 0.02 * len(pages)
