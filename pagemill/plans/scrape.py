"""Requests + captured responses + DNS answers -> dataset, as one Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import host_of, normalise_urls, resolve_url
from pagemill.operators.addresses import host_verdicts
from pagemill.operators.dataset import budget_cutoff, dataset_union, first_error
from pagemill.operators.requests import clean_requests, first_seen, request_options
from pagemill.operators.responses import content_type_ok, is_redirect, judged_nodes, reason_phrase, redirect_nodes, resolve_redirects, status_ok
from pagemill.options import DEFAULT, MSG_BAD_SCHEME, MSG_HTTP_STATUS, MSG_INVALID_URL, MSG_NOT_HTML, MSG_TOO_LARGE, Options
from pagemill.plans.clean import clean_pages
from pagemill.session import ensure_checkpoint_dir


def _fmt(msg: str, *cols) -> F.Column:
    return F.format_string(msg.replace("{}", "%s"), *cols)


def redirect_targets(responses: DataFrame) -> DataFrame:
    """Adds ``target``, where each response's Location leads as a normalised URL, and ``target_error``
    for a Location that is no web URL; bodies stay behind. A hop's current URL is its response's, so this holds for every chain."""
    raw = F.when(is_redirect(F.col("status")) & (F.coalesce(F.col("location"), F.lit("")) != ""), resolve_url("req_url", "location"))
    narrow = responses.select("req_url", "page_id", "status", "location", "content_type", "elapsed_ms", raw.alias("_raw"))
    d = normalise_urls(narrow, "_raw", "_t")
    web = F.col("_t.href").isNotNull() & F.col("_t.protocol").isin("http:", "https:")
    error = F.when(F.col("_raw").isNull() | web, F.lit(None).cast("string")) \
        .when(~F.coalesce(F.col("_t.valid"), F.lit(False)), _fmt(MSG_INVALID_URL, F.col("_raw"))) \
        .otherwise(_fmt(MSG_BAD_SCHEME, F.col("_t.protocol")))
    return d.withColumn("target", F.when(web, F.col("_t.href"))).withColumn("target_error", error).drop("_raw", "_t")


def scrape(requests: DataFrame, responses: DataFrame, dns: DataFrame, runs: DataFrame,
           opts: Options = DEFAULT) -> DataFrame:
    """Clean/dedupe requests, normalise, refuse private hosts, follow redirects with per-hop
    checks, apply status/type/size/time guards, clean the pages, route the first error, then
    apply each run's budget. Returns DATASET_COLUMNS rows (success and error records)."""
    ensure_checkpoint_dir(requests.sparkSession)
    reqs = request_options(first_seen(clean_requests(requests)), runs)
    if "mode" not in reqs.columns:
        reqs = reqs.withColumn("mode", F.lit(None).cast("string"))
    reqs = reqs.withColumn("mode", F.coalesce(F.col("mode"), F.when(F.col("render_js"), F.lit("render")).otherwise(F.lit("fetch"))))
    # lineage cuts (reliable checkpoints in spark.checkpoint.dir) of three narrow tables, the requests, the
    # redirect nodes and the outcomes before cleaning, which are used several times below; no body is among them
    n = normalise_urls(reqs, "url", "nu").checkpoint()
    web = F.col("nu.protocol").isin("http:", "https:") & F.col("nu.href").isNotNull()
    starts = n.where(web).select(F.col("nu.href").alias("src"))
    edges = redirect_targets(responses)
    hosts = starts.select(host_of(F.col("src")).alias("host")).unionByName(
        edges.where(F.col("target").isNotNull()).select(host_of(F.col("target")).alias("host")))
    verdicts = host_verdicts(hosts, dns, compat=opts.extra.get("textual_ipv6", False))
    nodes = judged_nodes(starts, redirect_nodes(edges), verdicts).checkpoint()
    chains = resolve_redirects(starts, None, timeout_ms=opts.timeout_ms, nodes=nodes)
    sizes = responses.select("page_id", F.octet_length("body").alias("nbytes"))
    r = n.join(chains, F.col("nu.href") == chains.src, "left").join(sizes, "page_id", "left")
    fetch = F.col("mode") == "fetch"
    status_msg = F.when(fetch, _fmt(MSG_HTTP_STATUS, F.col("status"), reason_phrase(F.col("status")), F.col("final_url"))) \
        .otherwise(F.format_string("The server returned HTTP %s for %s.", F.col("status"), F.col("nu.href")))
    err = first_error(
        (~F.coalesce(F.col("nu.valid"), F.lit(False)), _fmt(MSG_INVALID_URL, F.col("url"))),
        (~F.col("nu.protocol").isin("http:", "https:"), _fmt(MSG_BAD_SCHEME, F.col("nu.protocol"))),
        (F.col("chain_error").isNotNull(), F.col("chain_error")),
        (~status_ok(F.col("status")), status_msg),
        (fetch & ~content_type_ok(F.col("content_type")), _fmt(MSG_NOT_HTML, F.col("content_type"))),
        (fetch & (F.col("nbytes") > opts.max_bytes), F.lit(MSG_TOO_LARGE.format(opts.max_bytes))),
    )
    r = r.select("run_id", "ord", "url", F.col("nu.href").alias("href"), "page_id", "include_links",
                 err.alias("pre_error"))
    r = r.checkpoint()
    ok = r.where(F.col("pre_error").isNull())
    # one cleaning per (requested URL, final page, link option); the requested URL is the link base (Q4)
    key = F.concat_ws("|", F.col("href"), F.col("page_id").cast("string"), F.col("include_links").cast("string"))
    ok = ok.withColumn("key", key)
    # HTML moves once: distinct pages to clean joined to their bodies (bodies never join hops)
    bodies = responses.select("page_id", F.col("body").alias("html"))
    to_clean = ok.select("key", "href", "page_id", "include_links").dropDuplicates(["key"]).join(bodies, "page_id") \
        .select(F.col("key").alias("page_id"), F.col("href").alias("url"), "html", F.col("include_links").alias("lnk"))
    cleaned = clean_pages(to_clean, opts).withColumnRenamed("page_id", "key").drop("url").checkpoint()
    good = ok.join(cleaned, "key").select(
        "run_id", "ord", F.when(F.col("error").isNull(), F.col("href")).otherwise(F.col("url")).alias("url"),
        "title", "excerpt", "site_name", "word_count", "markdown", "error")
    bad = r.where(F.col("pre_error").isNotNull()).select("run_id", "ord", "url", F.col("pre_error").alias("error"))
    return budget_cutoff(dataset_union(good, bad), runs)
