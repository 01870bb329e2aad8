"""HTML -> Markdown goldens (G rows) and Spark/DuckDB parity on the same inputs."""

import time

import duckdb
import pytest

from oracles.html import clean_pages_duck
from pagemill.operators.tokens import with_tree
from pagemill.options import COMMONMARK, DEFAULT, Rule
from pagemill.plans.clean import clean_pages

BASE = "https://ex.com/dir/page"

CASES = {
    "headings": ("<h1>One</h1><h2>Two</h2><h6>Six</h6>", "# One\n\n## Two\n\n###### Six"),
    "emphasis": ("<p>a <b>bold</b> and <em>em</em> and <strong><i>both</i></strong></p>", "a **bold** and _em_ and **_both_**"),
    "inline_code": ("<p>use <code>x = 1</code> now</p>", "use `x = 1` now"),
    "fenced": ('<pre><code class="language-py">def f():\n    return 1\n</code></pre>', "```py\ndef f():\n    return 1\n```"),
    "bullets": ("<ul><li>a</li><li>b</li></ul>", "-   a\n-   b"),
    "ordered_start": ('<ol start="3"><li>c</li><li>d</li></ol>', "3.  c\n4.  d"),
    "nested": ("<ul><li>a<ul><li>b</li></ul></li></ul>", "-   a\n    -   b"),
    "link_relative": ('<p>see <a href="/x?y=1">there</a></p>', "see [there](https://ex.com/x?y=1)"),
    "link_dir_relative": ('<p><a href="other">o</a></p>', "[o](https://ex.com/dir/other)"),
    "image": ('<p><img src="i.png" alt="pic"></p>', "![pic](https://ex.com/dir/i.png)"),
    "blockquote": ("<blockquote><p>q1</p><p>q2</p></blockquote>", "> q1\n>\n> q2"),
    "hr": ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    "br": ("<p>a<br>b</p>", "a\nb"),
    "table": ("<table><tr><th>h1</th><th>h2</th></tr><tr><td>a</td><td>b</td></tr></table>",
              "| h1 | h2 |\n| --- | --- |\n| a | b |"),
    "strike": ("<p><del>old</del> new</p>", "~old~ new"),
    "tasks": ('<ul><li><input type="checkbox" checked> done</li><li><input type="checkbox"> todo</li></ul>',
              "-   [x] done\n-   [ ] todo"),
    "escapes": ("<p>*star* _u_ [b]</p><p># not heading</p><p>1. not list</p>",
                "\\*star\\* \\_u\\_ \\[b\\]\n\n\\# not heading\n\n1\\. not list"),
    "entities": ("<p>a &amp; b &copy; &#233; &#x1F600; &middot;</p>", "a & b © é \U0001F600 ·"),
    "script_with_p": ('<script>var t="</p>";</script><p>kept</p>', "kept"),
    "comment_with_tags": ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    "attr_gt": ('<p><a href="/a>b">t</a></p>', "[t](https://ex.com/a%3Eb)"),
    "upper_case": ("<P>Up <B>Bold</B></P>", "Up **Bold**"),
    "unclosed_p_b": ("<p><b>lead<br><p>next", "**lead**\n\nnext"),
    "stray_close": ("<p>a</b> b</p>", "a b"),
    "container": ("<div><a href='/a'>a</a> <a href='/b'>b</a></div><div><p>" + "alpha " * 20 + "</p><p>" + "beta " * 20
                  + "</p></div>", ("alpha " * 20).strip() + "\n\n" + ("beta " * 20).strip()),
    "removed": ("<noscript>x</noscript><iframe>y</iframe><form>z</form><p>w</p>", "w"),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, BASE, f"<html><head><title>T</title></head><body>{html}</body></html>")
            for i, (html, _) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r for r in clean_pages(df).collect()}, rows


@pytest.mark.parametrize("name", list(CASES))
def test_golden(results, name):
    got, _ = results
    i = list(CASES).index(name)
    assert got[i].markdown == CASES[name][1]


def test_duckdb_parity_on_goldens(results):
    got, rows = results
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    duck = {r[0]: r for r in con.execute(clean_pages_duck()).fetchall()}
    for i, r in got.items():
        assert duck[i][6] == r.markdown, (i, duck[i][6], r.markdown)


def test_strip_links(spark):
    df = spark.createDataFrame([(1, BASE, '<body><p>see <a href="/x">there</a></p></body>')], "page_id bigint, url string, html string")
    r = clean_pages(df, DEFAULT.with_(include_links=False)).first()
    assert r.markdown == "see there"


def test_fallback_and_blank(spark):
    rows = [
        (1, BASE, "<body><nav>menu</nav><div>only body text</div><footer>f</footer></body>"),
        (2, BASE, "<body><div></div></body>"),
        (3, BASE, "<body>   </body>"),
        (4, BASE, "<html><body><p>no title</p></body></html>"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in clean_pages(df).collect()}
    assert got[1].markdown == "only body text" and got[1].source == "fallback" and got[1].excerpt is None
    assert got[2].error is None and got[2].word_count == 0          # markup but no text: success, 0 words
    assert got[3].error == "The page loaded but contained no readable text content to extract."
    assert got[4].title == ""


def test_article_region_wins_over_chrome(spark):
    html = ("<body><nav><a href='/a'>A</a> <a href='/b'>B</a></nav><div class='ad'>buy</div>"
            "<article><h1>Head</h1><p>" + "word " * 30 + "</p></article><footer>c</footer></body>")
    r = clean_pages(spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")).first()
    assert r.source == "article"
    assert r.markdown.startswith("# Head\n\n") and "buy" not in r.markdown and "[A]" not in r.markdown
    assert r.word_count == 32


NESTED = {
    "<p><b>a<b>b<b>c<b>d</p>": "**abcd**",
    "<p>" + "<strong>" * 9 + "x" + "</strong>" * 9 + " y</p>": "**x** y",
    "<p><b>a<strong>b<b>c</b>d</strong>e</b> f <b>g</b></p>": "**abcde** f **g**",
    "<p><i>a<em>b<i>c</i></em></i> <s>d<del>e<s>f</s></del></s></p>": "_abc_ ~def~",
    "<p><b>a<i>b<b>c<i>d<b>e</b></i></b></i></b> z</p>": "**a_bcde_** z",
    "<p>a</b></b> <b>b</p>": "a **b**",
    "<p><code>a<code>b</code>c</code> d</p>": "`abc` d",
}


def test_nested_formatting_of_any_depth(spark):
    rows = [(i, BASE, f"<body>{html}</body>") for i, html in enumerate(NESTED)]
    got = {r.page_id: r.markdown for r in clean_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(NESTED.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[6] for r in con.execute(clean_pages_duck()).fetchall()} == got


WORDS = "word " * 30

TREES = {
    # a parent's end tag closes all it holds; chrome that is never closed doesn't hide the article in it
    f"<div><nav>menu<article><p>{WORDS}</p></article></div><p>after</p>": WORDS.strip(),
    f"<body><aside>note<main><h1>H</h1><p>{WORDS}</p></main>": f"# H\n\n{WORDS.strip()}",
    "<div><nav>menu</div><p>after</p>": "after",
    f"<nav><article><p>{WORDS}</p></article></nav><p>after</p>": "after",
    "<table><tr><td>x</div></td><td>y</table><p>z": "| x | y |\n| --- | --- |\n\nz",
    "<svg><title>no</title></svg><form>gone<div>x</div><p>y": "",
    "<ul><li>a<ul><li>b</ul>c<li>d</ul>": "-   a\n    -   b\n\n    c\n-   d",
    # nested tables are rendered into their cell
    "<table><tr><td>a<table><tr><td>1<td>2<tr><td>3</table><td>b</table>": "| a<br>1 \\| 2<br>3 | b |\n| --- | --- |",
    "<table><tr><td><table><tr><td>x<table><tr><td>deep</table>y</table><td>b<tr><td>c<td></table>": "| x<br>deep<br>y | b |\n| --- | --- |\n| c | |",
    "<table><tr><td><p>a</p><p>b<br>c</p></td><td><ul><li>x<li>y</ul></td></tr></table>": "| a<br>b<br>c | x<br>y |\n| --- | --- |",
    # no character passes for formatting
    "<p>x &#1;y&#2; z &#7;&#16;w&#17;/&#18;</p>": "x \x01y\x02 z \x07\x10w\x11/\x12",
    "<p><b>bold </b>x<i> em</i></p>": "**bold** x _em_",
    "<p><a href='/x'>one <b>two</b></a></p><a href=/y><p>blk</p></a>": "[one **two**](https://ex.com/x)\n\n[blk](https://ex.com/y)",
    "<p><i><b>x</b> y</i> <code>a*<b>b</b></code></p>": "_**x** y_ `a*b`",
    "<p><b>a</p><p>b</b></p>": "**a**\n\nb",
}


def test_trees_tables_and_typed_formatting(spark):
    rows = [(i, BASE, html) for i, html in enumerate(TREES)]
    got = {r.page_id: r.markdown for r in clean_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(TREES.values())


def test_plan_of_clean_pages(spark, sf001, capsys):
    """One scan, one exchange; no sort, window, join or aggregate."""
    plan = clean_pages(spark.read.parquet(f"{sf001}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    counts = {k: plan.count(k) for k in ("FileScan", "Exchange", "Sort", "Window", "Join", "Aggregate")}
    print(counts)
    assert counts == {"FileScan": 1, "Exchange": 1, "Sort": 0, "Window": 0, "Join": 0, "Aggregate": 0}


def test_hostile_nesting_takes_time_in_proportion():
    from pagemill.operators.tree import Fold

    fold = Fold()
    for marks in (["div"] * 60_000, ["b", "t"] * 30_000 + ["/b"] * 30_000, ["li", "span", "/td"] * 20_000, ["table", "tr", "td"] * 20_000 + ["/div"] * 20_000,
                  ["nav", "article", "p", "t"] * 15_000, ["ol", "li", "a:1", "t"] * 15_000):
        began = time.process_time()
        fold.page(marks)
        assert time.process_time() - began < 20


def test_rules_of_options(spark):
    html = "<p><mark>m</mark> <b>b</b> <s>s</s> <u>u</u></p><ul><li><input type=checkbox checked>t</ul><table><tr><td>a<td>b</table>"
    frame = spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")
    more = (Rule("mark", ("mark",), "==", "=="), Rule("bold", ("b",), "<b>", "</b>"), Rule("gone", ("u",), remove=True))
    assert clean_pages(frame, DEFAULT.with_(rules=DEFAULT.rules + more)).first().markdown == "==m== <b>b</b> ~s~\n\n-   [x] t\n\n| a | b |\n| --- | --- |"
    assert clean_pages(frame, DEFAULT.with_(rules=COMMONMARK)).first().markdown == "m **b** s u\n\n-   t\n\na b"
    assert clean_pages(frame, DEFAULT.with_(rules=COMMONMARK + (Rule("plain", ("b",)),))).first().markdown == "m b s u\n\n-   t\n\na b"


def test_page_arrays_are_made_in_bounded_batches(spark):
    """A Python worker holds the arrays of one batch of pages, however many a partition has; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(3000).selectExpr("id AS page_id", "'http://a.example/' AS url", "concat('<p>', id, '</p>') AS html")
    try:
        for held, most in (("10000", 500), ("0", 500), ("7", 7)):
            spark.conf.set(name, held)
            pages = with_tree(rows)
            assert int(spark.conf.get(name)) == most
            assert pages.where("size(tokens) = 3").count() == 3000
    finally:
        spark.conf.set(name, before)
