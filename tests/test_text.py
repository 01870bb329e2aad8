"""Scalar text functions against the FIXTURES vectors (tidy / words / trim)."""

import html

import duckdb
from pyspark.sql import functions as F

from pagemill.functions import sqltext as X
from oracles.dialect import DUCK
from pagemill.functions.dialect import SPARK
from pagemill.functions.text import js_trim, tidy_markdown, word_count

NBSP, BOM = " ", "﻿"
VECTORS = [  # input, tidy, words
    ("a\n\n\n\nb", "a\n\nb", 2),
    ("a\n \n \nb", "a\n\n\nb", 2),
    ("# T \n\n- x\t\n", "# T\n\n- x", 4),
    (f"a{NBSP}b", f"a{NBSP}b", 2),
    (f"{BOM}a", "a", 1),
    ("", "", 0),
]


def test_tidy_and_words(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, s string")
    rows = df.select("i", tidy_markdown("s").alias("t"), word_count("s").alias("w")).orderBy("i").collect()
    for r, (_, tidy, words) in zip(rows, VECTORS):
        assert r.t == tidy
        assert r.w == words


def test_js_trim_unicode(spark):
    s = "　  x y ﻿ "
    r = spark.createDataFrame([(s,)], "s string").select(js_trim("s").alias("t")).first()
    assert r.t == "x y"


def test_word_count_matches_python_split(spark):
    import re
    texts = ["", "a", " a  b ", "x y\tz", "**bold** _em_ | - #", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.w for r in df.select(word_count("s").alias("w")).collect()]
    js_ws = "[\t\n\u000b\f\r    -     　﻿]+"
    want = [len([p for p in re.split(js_ws, t) if p]) for t in texts]
    assert got == want


def both_engines(spark, rows, expression):
    """The expression over column s of the rows, on Spark and on DuckDB."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string")
    got = [r.v for r in df.select("i", F.expr(expression(SPARK)).alias("v")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(rows)))
    return got, [v for (v,) in con.execute(f"SELECT {expression(DUCK)} FROM t ORDER BY i").fetchall()]


REFERENCES = [
    "a &amp; b &#233; &#xe9;", "&#x0000000041;&#00000000065;", "&apos;&check;&nbsp;x", "&nbsp &eacute x", "&copy2024",
    "&notit; &notin;", "&unknown; &;& &#; &#x;", "&#150;&#x80;", "&#0;&#xD800;&#99999999999999999999;", "&bsol;&Tab;&fjlig;", "",
]


def test_character_references_as_the_standard_library_reads_them(spark):
    want = [html.unescape(s) for s in REFERENCES]
    for got in both_engines(spark, REFERENCES, lambda d: X.decode_entities(d, "s")):
        assert got == want


def test_attribute_keeps_names_that_run_on(spark):
    rows = ["?a=1&copy=2", "?a&amp;b", "?x&notit;", "&copy", "&lt 1"]
    for got in both_engines(spark, rows, lambda d: X.decode_entities(d, "s", attribute=True)):
        assert got == ["?a=1&copy=2", "?a&b", "?x&notit;", "\u00a9", "< 1"]


def test_dot_segments_of_any_depth(spark):
    paths = {
        "/a/b/c/d/../../../../e": "/e", "/a/b/c/d/f/../../../../../e": "/e", "/a" * 20 + "/.." * 20 + "/z": "/z", "/../../x": "/x",
        "/a//../b": "/a/b", "/a/%2E%2e/b": "/b", "/a/./b/.": "/a/b/", "/a/b/..": "/a/", "/": "/", "/..": "/", "/a/...": "/a/...",
    }
    for got in both_engines(spark, list(paths), lambda d: X.remove_dots(d, "s")):
        assert got == list(paths.values())
