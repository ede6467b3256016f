"""Main text against a plain cut of the given pages and on pages written for the purpose."""

import re
import time
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.llm.html_text import Page, extract_text, main_text
from fathomline.llm.queries import ORACLE_SQL, op12_html_text

PROSE = "Words of a real paragraph, long enough to weigh something, and a few more of them. "


def plain_cut(html):
    body = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    blocks = [" ".join(unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", body)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, sf_dir):
    got = op12_html_text(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r.text == plain_cut(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["op12_html_text"]).fetchall())


def test_page_without_article_element():
    html = (
        "<html><head><title>T</title></head><body><div id=top><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a></ul></div>"
        f"<div class=wrap><div class=x1><h2>Heading</h2><p>{PROSE * 4}<p>Short.<p>{PROSE * 3}</div><div class=x2><a href=4>One more</a> <a href=5>And another</a></div></div>"
        "<div class=x3>All rights reserved</div></body></html>"
    )
    assert main_text(html) == "\n".join(["Heading", (PROSE * 4).strip(), "Short.", (PROSE * 3).strip()])


@pytest.mark.parametrize(
    "around",
    [
        "<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<header>{}</header>", "<form>{}</form>", '<div class="ad">{}</div>', "<div id='cookie-notice'>{}</div>", "<div role=banner>{}</div>",
        '<section class="comments"><article class="c">{}</article></section>', '<ul class="Menu main">{}</ul>', "<script>var a = '<p>{}</p>';</script>", "<style>{}</style>", "<!-- <p>{}</p> -->", "<noscript><p>{}</p></noscript>", "<div hidden><p>{}</p></div>",
    ],
)
@pytest.mark.parametrize("article", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
def test_surroundings_go(around, article):
    noise = around.format(PROSE * 9)
    inside = f"<h1>The title</h1><p>{PROSE * 2}</p><p>Second &amp; last.<br>Line.</p>"
    pages = [f"<body>{noise}{article.format(inside)}{noise}</body>", f"<body>{article.format(inside + noise)}</body>"]
    for html in pages[:1] if "header" in around else pages:  # an article's own header belongs to it
        assert main_text(html) == f"The title\n{(PROSE * 2).strip()}\nSecond & last. Line."


def test_blocks_spaces_references():
    html = "<article>\n  Loose\ttext <b>bold</b><i>er</i> <p>a&nbsp; b&#x41;&lt;p&gt;<ul><li>x<li>y &am z</ul><table><tr><td>1<td>2</table><script>no</script>in<script></script>side</article>"
    assert main_text(html) == "Loose text bolder\na bA<p>\nx\ny &am z\n1\n2\ninside"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<p>", "<!--", "<!-- <p>a", "<a href='", "</p></div>", "<body></body>", "<script>", "<nav>x</nav>", "\x00"])
def test_pages_without_text(html):
    assert main_text(html) in ("", "<", "\x00")


def test_broken_markup():
    assert main_text("plain text & more") == "plain text & more"
    assert main_text("a <b>bold</div> c") == "a bold c"
    assert main_text('<p title="a > b">x</p>') == "x"
    assert main_text("<article><p>one<p>two") == "one\ntwo"
    assert main_text("3 < 4 <p>x") == "3 < 4\nx"
    assert main_text("<title>t</title><p>x</p>") == "x"


@pytest.mark.parametrize("html", ["<" * 200_000, "<div>" * 50_000 + "x", '<a b="' * 50_000, "<p><b><i>" * 30_000 + "x", "<li><div>" * 30_000 + "x", "&" * 200_000, "<!-" * 100_000, "<td>" * 50_000, "<article>" * 40_000 + "x" + "</article>" * 40_000, "<p>x</p>" * 50_000])
def test_long_and_deep_pages_in_linear_time(html):
    began = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - began < 10


def test_densities_by_hand():
    from math import e, log

    page = Page(f"<body><div><p>{'x' * 40}</p><p>{'y' * 20}<a href=1>{'z' * 20}</a></p></div></body>")
    density, sums = page.densities()
    share = 20 / 80
    plain = 40 / log(log(40 * 1 / 40 + share * 40 + e)) * log(40)
    linked = 40 / log(log(40 * 20 / 20 + share * 40 + e)) * log(2)
    div = page.tags.index("div")
    assert sums[div] == pytest.approx(plain + linked) and density[div] == pytest.approx(80 / 3 / log(log(80 * 20 / 60 + share * 80 + e)) * log(80 / 20 * 3))


def test_odd_tables(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "<article><p>x</p></article>", "b"), (None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumns({"_body": F.lit("kept"), "n_chars": F.lit(7)})
    got = extract_text(df)
    assert sorted(map(str, got.select("page_id", "text", "n_chars", "_body").collect())) == sorted(map(str, df.selectExpr("page_id", "if(page_id = 2, 'x', '') text", "if(page_id = 2, 1L, 0L) n_chars", "_body").collect()))
    assert extract_text(df.filter("page_id = 9")).collect() == []
