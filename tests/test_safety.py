"""Hostile hosts and redirects: nothing private is fetched and no string ends the job."""

from pyspark.sql import functions as F

from pagemill.functions.sqlfuncs import register_sql_functions
from pagemill.functions.urls import is_private_address, is_private_ipv4, normalise_urls
from pagemill.operators.addresses import host_verdicts
from pagemill.operators.responses import assemble_body, resolve_redirects
from pagemill.plans.scrape import redirect_targets

URLS = {
    "http://0xfffffffffffffffffffff/": None, "http://0xfffffffffffffffffffff.com/": "http://0xfffffffffffffffffffff.com/",
    "http://0777777777777777777777777/": None, "http://99999999999999999999/": None, "http://08.0.0.1/": None,
    "http://010.0.0.1/": "http://8.0.0.1/", "http://0x7f.1/": "http://127.0.0.1/", "http://a.com:000080/": "http://a.com/",
    "http://a.com:99999999999/": None, "http://a.com/a/b/c/d/../../../../e": "http://a.com/e", "http://a.com/a/%2e%2e/b": "http://a.com/b",
    "http://a.com/" + "x/" * 20 + "../" * 20 + "y": "http://a.com/y", "http://a.com/a//../b": "http://a.com/a/b",
}


def test_urls_never_fail_the_job(spark):
    rows = normalise_urls(spark.createDataFrame([(u,) for u in URLS], "raw string"), "raw", "u").select("raw", "u.href").collect()
    assert {r["raw"]: r["href"] for r in rows} == URLS


def test_private_ipv4_alike_in_columns_and_sql(spark):
    register_sql_functions(spark)
    ips = ["10.0.0.1", "010.0.0.1", "8.8.8.8", "172.16.0.1", "172.32.0.1", "100.64.1.1", "169.254.169.254", "192.168.1.1", "192.167.1.1", "256.1.1.1", "1.2.3", "99999999999999999999.1.1.1", "x"]
    d = spark.createDataFrame([(i,) for i in ips], "ip string")
    for r in d.select("ip", is_private_ipv4("ip").alias("a"), F.expr("pm_is_private_ipv4(ip)").alias("b")).collect():
        assert r["a"] == r["b"], r["ip"]


LOCATIONS = ["//169.254.169.254/latest", " http://10.0.0.1/", "HTTP://10.0.0.1/", "http://0x7f.1/", "http://[0:0:0:0:0:0:0:1]/", "http://[::ffff:10.0.0.1]/", "http://unseen.example/", "file:///etc/passwd"]


def test_redirects_into_private_hosts_are_refused(spark):
    schema = "req_url string, status int, location string, content_type string, elapsed_ms long, page_id long"
    starts = [f"http://public.example/{i}" for i in range(len(LOCATIONS))]
    inner = ("http://169.254.169.254/latest", "http://10.0.0.1/", "http://127.0.0.1/", "http://[0:0:0:0:0:0:0:1]/", "http://[::ffff:10.0.0.1]/", "http://unseen.example/", "file:///etc/passwd")
    pages = [(u, 302, to, "text/html", 1, 1) for u, to in zip(starts, LOCATIONS)] + [(u, 200, None, "text/html", 1, 2) for u in inner]
    responses = redirect_targets(spark.createDataFrame(pages, schema))
    dns = spark.createDataFrame([("public.example", 0, "93.184.216.34")], "host string, seq int, address string")
    hosts = spark.createDataFrame([("public.example",), ("169.254.169.254",), ("10.0.0.1",), ("127.0.0.1",), ("0:0:0:0:0:0:0:1",), ("::ffff:10.0.0.1",)], "host string")
    verdicts = host_verdicts(hosts, dns, compat=False).checkpoint()
    rows = resolve_redirects(spark.createDataFrame([(u,) for u in starts], "src string"), responses, verdicts, max_hops=1).collect()
    assert len(rows) == len(LOCATIONS)
    assert all(r["chain_error"] and "redirected too many" not in r["chain_error"] for r in rows)


def test_ipv6_is_judged_by_number(spark):
    d = spark.createDataFrame([("0:0:0:0:0:0:0:1",), ("2606:4700::1",), ("fe80::1",)], "ip string")
    assert [r[0] for r in d.select(is_private_address("ip", compat=False)).collect()] == [True, False, True]


def test_binary_chunks_are_joined_before_decoding(spark):
    data = "né".encode()
    d = spark.createDataFrame([("u", 0, bytearray(data[:2])), ("u", 1, bytearray(data[2:]))], "req_url string, seq int, chunk binary")
    r = assemble_body(d, 100).first()
    assert (r["total_bytes"], r["body"]) == (3, "né")
