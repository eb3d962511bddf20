"""HTML extraction on planted pages, and against a plainer rule on the table's pages."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from rankbench.llm import html_text
from rankbench.llm.queries import QUERIES

PROSE = "This is a long sentence, with commas, about something that a reader wants to know."

PAGES = [
    (None, ""),
    ("", ""),
    ("plain text only", "plain text only"),
    ("<nav><a href=x>menu</a></nav>", ""),
    (f"<p>{PROSE}</p><p>Short.</p>", f"{PROSE}\nShort."),
    (
        f"<body><header>Site</header><nav>Home</nav><article><h1>Title</h1><p>{PROSE}<p>A&amp;B &lt;x&gt; &eacute;&nbsp; &#65;"
        f"<script>var a='</p>'</script> tail</article><aside>{PROSE}</aside><footer>{PROSE}</footer></body>",
        f"Title\n{PROSE}\nA&B <x> é A tail",
    ),
    (
        f"<div class='sidebar'><p>{PROSE}</p></div><div id=content class='has-sidebar'><p>{PROSE}</p><div class=ad><p>{PROSE}</p></div>"
        f"<p>one<br>two\n three</p><form><p>{PROSE}</p></form></div><div id='comments'><p>{PROSE}</p><p>{PROSE}</p></div>",
        f"{PROSE}\none two three",
    ),
    (f"<article><p><b>Head<br><p>{PROSE}</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", f"Head\n{PROSE}\na\nb\nc\nd"),
    (f"<article><!-- <p>no</p> --><p>{PROSE}</p><p class='ad'>buy<p>after, that</article><p style='display: none'>x", f"{PROSE}\nafter, that"),
    (f"<div class=ad><span>x</span><div>y</div></div><main><p>{PROSE}</p></main>", PROSE),
    (f"<article><span class=ad>a<span>b</span>c</span><p>{PROSE}</p><p>cut &am", f"{PROSE}\ncut &am"),
    (f"<nav><ul><li><a>x</ul></nav><article><p>{PROSE} <a href='/y'>link</a></p></article>", f"{PROSE} link"),
    ("<article><p>Tiny.</p></article><div class=ad>" + PROSE + "</div><footer>" + PROSE * 3 + "</footer>", "Tiny."),
    ("<" + "div>" * 20 + "x < y and a<b", "div>" * 19 + "x < y and a"),
]


@pytest.mark.parametrize("page, text", PAGES[:-1])
def test_planted(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("name", ["table-responsive", "container responsive", "bg-navy", "navy-blue box", "navajo"])
def test_wrappers_that_only_sound_unwanted(name):
    page = f"<body><div class='{name}'><p>{PROSE}</p><table><tr><td>a<td>b</table></div></body>"
    assert html_text.extract(page) == f"{PROSE}\na\nb"


@pytest.mark.parametrize("name", ["nav", "navbar", "main-nav", "nav-tabs", "navigation", "respond", "responses", "user_response"])
def test_wrappers_that_are_unwanted(name):
    page = f"<body><div class='{name}'><p>{PROSE}</p></div><article><p>Text.</p></article></body>"
    assert html_text.extract(page) == "Text."


LONG = "Words, more words, and still more of them, " * 7 + "end."


@pytest.mark.parametrize("outer", ["article", "main", "div class=page", "div"])
@pytest.mark.parametrize("part", ["section", "div"])
@pytest.mark.parametrize("wrap", ["", "div"])
def test_one_long_and_several_short_parts(outer, part, wrap):
    def made(title, n):
        text = f"<{part}><h2>{title}</h2>" + f"<p>{LONG}</p>" * n + f"</{part}>"
        return f"<{wrap}>{text}</{wrap}>" if wrap else text

    page = (
        f"<body><nav>Home</nav><{outer}>" + made("A", 5) + made("B", 30) + "<h4>Small</h4><ul><li>x<li>y</ul>"
        f"<table><tr><td>c</table><figure>f</figure>{LONG}" + made("C", 1)
        + "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>"
        + f"<div class=related>{LONG}</div></{outer.split()[0]}><footer>Foot</footer></body>"
    )
    blocks = ["A", *[LONG] * 5, "B", *[LONG] * 30, "Small", "x", "y", "c", "f", LONG, "C", LONG]
    assert html_text.extract(page) == "\n".join(blocks)


def test_linked_headings_of_an_article_stay():
    page = f"<article><h2><a href=1>T</a></h2><section>{f'<p>{LONG}</p>' * 30}</section><section><p>{LONG}</p></section></article>"
    assert html_text.extract(page) == "\n".join(["T", *[LONG] * 31])


def test_what_stands_beside_an_article_stays_out():
    page = f"<body><div>About us, and a few words more.</div><article><p>{LONG}</p></article><div>Made with care.</div></body>"
    assert html_text.extract(page) == LONG


def test_broken_and_long_pages():
    for page in (PAGES[-1][0], "<div>" * 5000 + "deep", "<p" * 100, "</p></div></x>t", "<a b='c>x", "<!--", "<script>"):
        assert isinstance(html_text.extract(page), str)
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert html_text.extract(long).count("\n") == 4999


def test_column(spark):
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAGES)], "page_id int, html string")
    found = rows.withColumn("text", F.lit("clash")).select("page_id", html_text.main_text(F.col("html")).alias("t"))
    assert {r["page_id"]: r["t"] for r in found.collect()} == {
        k: html_text.extract(p) for k, (p, _) in enumerate(PAGES)
    }
    assert rows.limit(0).select(html_text.main_text(F.col("html"))).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = {r["page_id"]: r for r in QUERIES["op5_html_extraction"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        found = re.search(r"<article>(.*?)(?:</article>|$)", page["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "br" in b else "", b)).split()) for b in blocks]
        row = rows[page["page_id"]]
        assert row["text"] == "\n".join(filter(None, plain))
        assert row["n_chars"] == len(row["text"])



def in_article(extra: str) -> str:
    paragraphs = "".join(f"<p>Paragraph {k}: {PROSE}</p>" for k in range(4))
    return f"<html><body><article><h1>Title</h1>{paragraphs}{extra}<p>The end: {PROSE}</p></article></body></html>"


@pytest.mark.parametrize(
    "name",
    "cookie-content newsletter-body sponsored-content related-post promo-text popup-content share-post "
    "modal-body subscribe-content banner-text alert-body hidden skip-link widget-area tags-links".split(),
)
def test_adverts_and_notices_in_an_article_go(name):
    notice = "<a href=x>Read this too</a>" if name in ("widget-area", "tags-links") else f"<p>Not the article. {PROSE}</p>"
    text = html_text.extract(in_article(f'<div class="{name}">{notice}</div>'))
    assert "Not the article" not in text and "Read this too" not in text
    assert text == html_text.extract(in_article(""))


@pytest.mark.parametrize(
    "name", "tags legal copyright disclaimer search head hidden-gem skip-intro social share".split()
)
def test_prose_in_an_article_stays_whatever_its_section_is_called(name):
    text = html_text.extract(in_article(f'<section class="{name}"><h2>A part</h2><p>Stays here. {PROSE}</p></section>'))
    assert "A part\nStays here." in text
    if name in ("hidden-gem", "skip-intro"):
        return  # names that say nothing
    # a list of links of that name goes
    links = "".join(f"<li><a href=/{k}>word {k}</a></li>" for k in range(5))
    assert "word 3" not in html_text.extract(in_article(f'<div class="{name}"><ul>{links}</ul></div>'))


def test_math_stays():
    page = in_article("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds, as we know.</p>")
    assert "Energy E=m holds, as we know." in html_text.extract(page)


MB = 1_000_000


@pytest.mark.parametrize(
    "kind, page",
    {
        "open inline": "<font>" * (MB // 6),
        "stray closing": "<div>" * (MB // 9) + "</i>" * (MB // 9),
        "one quote": '<a "' + "<a " * (MB // 3),
        "one quote of each kind": "<a '" + '<a "' * (MB // 4 - 1) + "'",
        "attributes without end": "<a " + "x='y=\"" * (MB // 6),
        "voids under open inline": "<p><object><table><td>" + "<font>" * 80_000 + "<hr>" * 80_000,
        "script without end": "<script>" + "</script " * (MB // 9),
        "in a dropped element": "<nav>" + "<div>" * 90_000 + "</i>" * 100_000,
        "weak names": "<div class=tags>" * 60_000 + "x",
        "less-than signs": "<" * MB,
    }.items(),
)
def test_time_follows_size(kind, page):
    """A tenth of the page takes about a tenth of the time: no kind is quadratic."""

    def seconds(text):
        start = time.process_time()
        html_text.extract(text)
        return time.process_time() - start

    small, large = seconds(page[: MB // 10]), seconds(page)
    assert large < 30 * max(small, 0.02), kind
    assert large < 6, kind
