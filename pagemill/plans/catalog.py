"""Registered queries (one per SURVEY section-2 operator); their DuckDB SQL is in ``oracles``.

Every query reads the driver tables (or tables Spark derives from them) in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import js_trim, tidy_markdown, word_count
from pagemill.functions.urls import host_of, ipv4_to_long, is_private_ipv4, long_to_ipv4, normalise_urls
from pagemill.operators import blocks as B
from pagemill.operators import tokens as T
from pagemill.operators.addresses import flag_private, host_verdicts, refused_ranges_df
from pagemill.operators.dataset import (budget_cutoff, dataset_union, first_error, meter_events, render_document,
                                        run_status, run_summary, unprocessed)
from pagemill.operators.requests import clean_requests, first_seen, request_options, validate_runs
from pagemill.operators.responses import assemble_body, body_bytes, content_type_ok, reason_phrase, resolve_redirects, status_ok
from pagemill.options import DEFAULT, MSG_BAD_SCHEME, MSG_HTTP_STATUS, MSG_INVALID_URL, MSG_NOT_HTML, MSG_TOO_LARGE
from pagemill.plans.clean import clean_pages
from pagemill.plans.scrape import scrape
from pagemill.sources import fixtures as FX

TEST_MAX_BYTES = 4000      # size/time tests hit both sides of each guard (FIXTURES section 2)
TEST_TIMEOUT_MS = 5000


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark, sf):
    return _t(spark, sf, "pages")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows of a table that has fewer files than the cluster has cores (e.g. one large row
    group); tables of many files (the large-scale case) are read as they lie."""
    par = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(par) if files < par else df


def _on_pages(fn):
    return lambda spark, sf: fn(_pages(spark, sf))


def q_remove_elements(spark, sf):
    p = T.partition_pages(_pages(spark, sf))
    return p.selectExpr("page_id", f"{T.clean_html('html')} AS h")


# ---------------------------------------------------------------------------
# scalar functions over whole tables
# ---------------------------------------------------------------------------
def q_js_trim(spark, sf):
    return spread(_t(spark, sf, "documents")).select("doc_id", js_trim("text").alias("trimmed"))


def q_word_count(spark, sf):
    return spread(_t(spark, sf, "documents")).select("doc_id", word_count("text").alias("words"))


def q_tidy_markdown(spark, sf):
    return spread(_t(spark, sf, "documents")).select("doc_id", tidy_markdown("text").alias("tidy"))


def q_page_markdown(spark, sf):
    return clean_pages(_pages(spark, sf)).select("page_id", "markdown", "word_count")


def q_clean_pages(spark, sf):
    return clean_pages(_pages(spark, sf))


def q_clean_pages_nolinks(spark, sf):
    return clean_pages(_pages(spark, sf), DEFAULT.with_(include_links=False)).select("page_id", "markdown", "word_count")


def q_render_document(spark, sf):
    return render_document(clean_pages(_pages(spark, sf))).select("page_id", "document")


# ---------------------------------------------------------------------------
# URLs, hosts, addresses
# ---------------------------------------------------------------------------
def q_normalise_url(spark, sf):
    p = normalise_urls(FX.requests(spark, sf).select("run_id", "ord", "raw_url"), "raw_url", "u")
    return p.select("run_id", "ord", F.col("u.href").alias("href"), F.col("u.protocol").alias("protocol"),
                    F.col("u.valid").alias("valid"))


def q_scheme_filter(spark, sf):
    """B2 as a predicate column over every request (filtering on the parsed struct would make
    Catalyst copy the whole parser into the filter condition)."""
    p = q_normalise_url(spark, sf)
    return p.select("run_id", "ord", "valid",
                    (F.coalesce(F.col("valid"), F.lit(False)) & F.col("protocol").isin("http:", "https:")).alias("allowed"))


def q_host_of(spark, sf):
    return _pages(spark, sf).select("page_id", host_of(F.col("url")).alias("host"))


def q_private_ipv4(spark, sf):
    a = FX.addresses(spark, sf)
    ip = long_to_ipv4(F.col("n"))
    return a.select("id", ip.alias("ip"), is_private_ipv4(ip).alias("private"))


IPV6_FORMS = ("CASE id % 5 WHEN 0 THEN '::ffff:' || ip4 WHEN 1 THEN 'fe80::' || CAST(n % 9999 AS STRING) "
              "WHEN 2 THEN '2001:db8::' || CAST(n % 9999 AS STRING) WHEN 3 THEN 'fd' || CAST(n % 89 + 10 AS STRING) || '::1' "
              "ELSE CASE WHEN n % 2 = 0 THEN '::1' ELSE '::' END END")


def q_private_ipv6(spark, sf):
    """B6 (the reference's textual rule, Q3) over IPv6 forms derived from every address row."""
    from pagemill.functions.urls import is_private_ipv6
    a = FX.addresses(spark, sf).select("id", "n", long_to_ipv4(F.col("n")).alias("ip4"))
    v6 = a.select("id", F.expr(IPV6_FORMS).alias("ip6"))
    return v6.select("id", "ip6", is_private_ipv6(F.col("ip6"), compat=True).alias("private"))


def q_distinct_urls(spark, sf):
    from pagemill.operators.requests import distinct_urls
    return distinct_urls(clean_requests(FX.requests(spark, sf)))


def q_refused_ranges(spark, sf):
    return flag_private(FX.addresses(spark, sf), refused_ranges_df(spark)).select("id", "n", "cidr")


def q_host_verdicts(spark, sf):
    hosts = _pages(spark, sf).select(host_of(F.col("url")).alias("host"))
    return host_verdicts(hosts, FX.dns_answers(spark, sf))


# ---------------------------------------------------------------------------
# requests
# ---------------------------------------------------------------------------
def q_clean_requests(spark, sf):
    return clean_requests(FX.requests(spark, sf)).select("run_id", "ord", "url")


def q_first_seen(spark, sf):
    return first_seen(clean_requests(FX.requests(spark, sf))).select("run_id", "ord", "url")


def q_validate_runs(spark, sf):
    return validate_runs(FX.runs(spark, sf), first_seen(clean_requests(FX.requests(spark, sf))))


def q_request_options(spark, sf):
    u = first_seen(clean_requests(FX.requests(spark, sf))).select("run_id", "ord", "url")
    return request_options(u, FX.runs(spark, sf)).select("run_id", "ord", "include_links", "event_limit", "event_name")


# ---------------------------------------------------------------------------
# responses
# ---------------------------------------------------------------------------
def q_assemble_body(spark, sf):
    return assemble_body(FX.chunks(spark, sf), TEST_MAX_BYTES)


def q_size_cap(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("req_url", F.octet_length("body").cast("bigint").alias("bytes"),
                    (F.octet_length("body") > TEST_MAX_BYTES).alias("too_large"))


def q_status_filter(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("req_url", "status", status_ok(F.col("status")).alias("ok"),
                    F.when(~status_ok(F.col("status")) & ~F.col("status").between(300, 399),
                           F.format_string(MSG_HTTP_STATUS.replace("{}", "%s"), F.col("status"), reason_phrase(F.col("status")),
                                           F.col("req_url"))).alias("error"))


def q_content_type_filter(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("req_url", content_type_ok(F.col("content_type")).alias("ok"),
                    F.when(~content_type_ok(F.col("content_type")),
                           F.format_string(MSG_NOT_HTML.replace("{}", "%s"), F.col("content_type"))).alias("error"))


def q_resolve_redirects(spark, sf):
    r = FX.responses(spark, sf)
    starts = _pages(spark, sf).select(F.col("url").alias("src"))
    return resolve_redirects(starts, r).select("src", "final_url", "hops", "status", "chain_error")


def q_checked_redirects(spark, sf):
    """C3 with the verdict of every hop's host."""
    r = FX.responses(spark, sf)
    starts = _pages(spark, sf).select(F.col("url").alias("src"))
    verdicts = host_verdicts(starts.select(host_of(F.col("src")).alias("host")), FX.dns_answers(spark, sf))
    return resolve_redirects(starts, r, verdicts).select("src", "final_url", "hops", "chain_error")


def q_element_tree(spark, sf):
    """E4 on pages some of whose end tags are missing."""
    return T.element_tree(FX.unclosed_pages(spark, sf))


def q_rich_markdown(spark, sf):
    """Pages with lists, quotes, code, tables, images, rules, strikethrough and tasks."""
    return clean_pages(FX.rich_pages(spark, sf)).select("page_id", "markdown", "word_count")


def q_tripping_chunk(spark, sf):
    """E3 + D6: bytes of each body and the chunk that passes the cap."""
    return body_bytes(FX.chunks(spark, sf), TEST_MAX_BYTES)


def q_timeout_filter(spark, sf):
    r = FX.responses(spark, sf)
    starts = _pages(spark, sf).select(F.col("url").alias("src"))
    return resolve_redirects(starts, r, timeout_ms=TEST_TIMEOUT_MS).select("src", "hops", "elapsed", "chain_error")


# ---------------------------------------------------------------------------
# dataset, budget, metering (single-hop outcomes, SQL-expressible)
# ---------------------------------------------------------------------------
def fetch_outcomes(spark, sf) -> DataFrame:
    """B16 over requests + their direct responses: (run_id, ord, url, error)."""
    u = first_seen(clean_requests(FX.requests(spark, sf))).select("run_id", "ord", "url")
    p = normalise_urls(u, "url", "nu")
    resp = FX.responses(spark, sf).select("req_url", "status", "content_type", F.octet_length("body").alias("nbytes"))
    j = p.join(resp, F.col("nu.href") == F.col("req_url"), "left")
    err = first_error(
        (~F.col("nu.valid"), F.format_string(MSG_INVALID_URL.replace("{}", "%s"), F.col("url"))),
        (~F.col("nu.protocol").isin("http:", "https:"), F.format_string(MSG_BAD_SCHEME.replace("{}", "%s"), F.col("nu.protocol"))),
        (F.col("status").isNull(), F.lit("Could not reach the page: no captured response.")),
        (~status_ok(F.col("status")), F.format_string(MSG_HTTP_STATUS.replace("{}", "%s"), F.col("status"),
                                                      reason_phrase(F.col("status")), F.col("nu.href"))),
        (~content_type_ok(F.col("content_type")), F.format_string(MSG_NOT_HTML.replace("{}", "%s"), F.col("content_type"))),
        (F.col("nbytes") > TEST_MAX_BYTES, F.lit(MSG_TOO_LARGE.format(TEST_MAX_BYTES))),
    )
    return j.select("run_id", "ord", F.when(err.isNull(), F.col("nu.href")).otherwise(F.col("url")).alias("url"),
                    err.alias("error"))


def q_first_error(spark, sf):
    return fetch_outcomes(spark, sf)


def q_dataset_union(spark, sf):
    o = fetch_outcomes(spark, sf)
    ok = o.where(F.col("error").isNull()).select("run_id", "ord", "url")
    bad = o.where(F.col("error").isNotNull())
    return dataset_union(ok, bad).select("run_id", "ord", "url", "error")


def q_budget_cutoff(spark, sf):
    return budget_cutoff(fetch_outcomes(spark, sf), FX.runs(spark, sf)).select("run_id", "ord", "error")


def q_unprocessed(spark, sf):
    reqs = first_seen(clean_requests(FX.requests(spark, sf))).select("run_id", "ord")
    delivered = budget_cutoff(fetch_outcomes(spark, sf), FX.runs(spark, sf))
    return unprocessed(reqs, delivered)


def q_run_summary(spark, sf):
    return run_summary(budget_cutoff(fetch_outcomes(spark, sf), FX.runs(spark, sf)), FX.runs(spark, sf))


def q_run_status(spark, sf):
    runs = FX.runs(spark, sf)
    summary = run_summary(budget_cutoff(fetch_outcomes(spark, sf), runs), runs)
    val = validate_runs(runs, first_seen(clean_requests(FX.requests(spark, sf))))
    return run_status(summary, val)


def q_meter_events(spark, sf):
    runs = FX.runs(spark, sf)
    delivered = budget_cutoff(fetch_outcomes(spark, sf), runs)
    u = first_seen(clean_requests(FX.requests(spark, sf))).select("run_id", "ord", "url")
    return meter_events(delivered, request_options(u, runs))


def q_meter_hourly(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))


def q_scrape(spark, sf):
    return scrape(FX.requests(spark, sf), FX.responses(spark, sf), FX.dns_answers(spark, sf), FX.runs(spark, sf))


def queries() -> dict:
    q = {
        "js_trim": q_js_trim, "word_count": q_word_count, "tidy_markdown": q_tidy_markdown,
        "page_markdown": q_page_markdown, "clean_pages": q_clean_pages, "clean_pages_nolinks": q_clean_pages_nolinks,
        "render_document": q_render_document,
        "html_tokens": _on_pages(T.html_tokens),
        "remove_elements": q_remove_elements,
        "strip_chrome": _on_pages(T.strip_chrome),
        "block_features": _on_pages(B.block_features),
        "link_table": _on_pages(T.link_table),
        "resolve_links": lambda s, sf: T.link_table(_pages(s, sf)).select("page_id", "pos", "abs_href"),
        "neighbour_blocks": _on_pages(B.neighbour_blocks),
        "container_scores": _on_pages(B.container_scores),
        "extract_article": _on_pages(B.extract_article),
        "content_or_fallback": _on_pages(B.content_or_fallback),
        "md_blocks": _on_pages(B.md_blocks),
        "page_metadata": _on_pages(B.page_metadata),
        "host_of": q_host_of, "private_ipv4": q_private_ipv4, "private_ipv6": q_private_ipv6,
        "distinct_urls": q_distinct_urls, "refused_ranges": q_refused_ranges,
        "normalise_url": q_normalise_url, "scheme_filter": q_scheme_filter, "host_verdicts": q_host_verdicts,
        "clean_requests": q_clean_requests, "first_seen": q_first_seen, "validate_runs": q_validate_runs,
        "request_options": q_request_options,
        "assemble_body": q_assemble_body, "size_cap": q_size_cap, "status_filter": q_status_filter,
        "content_type_filter": q_content_type_filter, "resolve_redirects": q_resolve_redirects,
        "timeout_filter": q_timeout_filter,
        "first_error": q_first_error, "dataset_union": q_dataset_union, "budget_cutoff": q_budget_cutoff,
        "unprocessed": q_unprocessed, "run_summary": q_run_summary, "run_status": q_run_status,
        "meter_events": q_meter_events, "meter_hourly": q_meter_hourly,
        "checked_redirects": q_checked_redirects, "element_tree": q_element_tree, "rich_markdown": q_rich_markdown, "tripping_chunk": q_tripping_chunk, "scrape": q_scrape,
    }
    return q
