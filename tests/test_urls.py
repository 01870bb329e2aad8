"""URL normalisation and private-address vectors (FIXTURES section 3)."""

from pyspark.sql import functions as F

from pagemill.functions.urls import is_private_address, normalise_urls

NORMALISE = [
    (" HTTP://Example.COM ", "http://example.com/"),
    ("https://example.com:443/a", "https://example.com/a"),
    ("http://example.com:8080", "http://example.com:8080/"),
    ("http://example.com/a/../b/./c", "http://example.com/b/c"),
    ("http://example.com/é", "http://example.com/%C3%A9"),
    ("http://example.com/a?x=1 2#top", "http://example.com/a?x=1%202#top"),
    ("http://example.com#top", "http://example.com/#top"),
    ("http:example.com", "http://example.com/"),
    ("http:\\\\example.com\\x", "http://example.com/x"),
    ("http://exa\tmple.com/", "http://example.com/"),
    ("http://2130706433/", "http://127.0.0.1/"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://münchen.example/", "http://xn--mnchen-3ya.example/"),
    ("http://[0:0:0:0:0:0:0:1]:80/", "http://[::1]/"),
    ("http://[2001:DB8:0:0:1:0:0:1]/x", "http://[2001:db8::1:0:0:1]/x"),
    ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"),
    ("http://@a.com/", "http://a.com/"),
    ("http://u:@a.com/", "http://u@a.com/"),
    ("http://u:p@a.com/", "http://u:p@a.com/"),
    ("http://%61.com/", "http://a.com/"),
    ("http://a.com\\b/../c", "http://a.com/c"),
    ("file:///x", "file:///x"),
]
INVALID = ["example.com", "not a url", "", "http://a b.com/", "http://[1:2]/", "http://[::1", "http://a%zz/", "http://a%00b/", "http:///"]
REFUSED = ["0.1.2.3", "10.0.0.1", "100.64.0.0", "100.127.255.255", "127.0.0.1", "169.254.169.254", "172.16.0.0",
           "172.31.255.255", "192.168.1.1", "::1", "::", "fe80::1", "fc00::1", "fd12::1", "::ffff:10.0.0.1"]
ALLOWED = ["8.8.8.8", "100.63.255.255", "100.128.0.0", "172.15.255.255", "172.32.0.0", "192.167.255.255", "11.0.0.0",
           "2001:db8::1", "::ffff:8.8.8.8"]


def test_normalise_vectors(spark):
    rows = [(i, raw) for i, (raw, _) in enumerate(NORMALISE)] + [(100 + i, raw) for i, raw in enumerate(INVALID)]
    df = normalise_urls(spark.createDataFrame(rows, "i int, raw string"), "raw", "u")
    got = {r.i: r for r in df.select("i", "u.href", "u.valid", "u.protocol").collect()}
    for i, (raw, want) in enumerate(NORMALISE):
        assert got[i].href == want, (raw, got[i].href)
    for i, raw in enumerate(INVALID):
        assert got[100 + i].href is None, raw


def test_scheme_errors(spark):
    df = normalise_urls(spark.createDataFrame([(1, "ftp://x/y"), (2, "mailto:x@y")], "i int, raw string"), "raw", "u")
    got = {r.i: r.protocol for r in df.select("i", "u.protocol").collect()}
    assert got == {1: "ftp:", 2: "mailto:"}


def test_private_classes(spark):
    df = spark.createDataFrame([(a, True) for a in REFUSED] + [(a, False) for a in ALLOWED], "ip string, want boolean")
    for r in df.select("ip", "want", is_private_address(F.col("ip")).alias("got")).collect():
        assert r.got == r.want, r.ip


def test_dictionary_has_each_url_once(spark):
    from pagemill.functions.urls import url_dictionary

    raw = ["http://10.0.0.1/", "http://10.0.0.1/", "http://[::1]/a", "http://A.com", "x", None, "http://8.8.8.8/"]
    got = {r["raw"]: (r["href"], r["host"], r["kind"], r["private"]) for r in url_dictionary(spark.createDataFrame([(u,) for u in raw], "u string"), "u").collect()}
    assert got == {"http://10.0.0.1/": ("http://10.0.0.1/", "10.0.0.1", 4, True), "http://[::1]/a": ("http://[::1]/a", "::1", 6, True),
                   "http://A.com": ("http://a.com/", "a.com", 0, None), "x": (None, None, None, None), "http://8.8.8.8/": ("http://8.8.8.8/", "8.8.8.8", 4, False)}
