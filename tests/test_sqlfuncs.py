"""K4: SQL temporary functions behave like the column functions."""

from pagemill.functions.sqlfuncs import register_sql_functions


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT pm_word_count(' a  b ') AS w, pm_tidy_markdown('a\\n\\n\\n\\nb ') AS t, "
                  "pm_js_trim('  x ') AS j, pm_decode_entities('a &amp; &#233;') AS d, "
                  "pm_resolve_url('https://e.com/a/b', '../c') AS u, pm_is_private_ipv4('10.1.2.3') AS p1, "
                  "pm_is_private_ipv4('8.8.8.8') AS p2").first()
    assert (r.w, r.t, r.j, r.d, r.u, r.p1, r.p2) == (2, "a\n\nb", "x", "a & é", "https://e.com/c", True, False)
