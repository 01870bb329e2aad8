"""DuckDB SQL for the registered queries, written from their rules."""

from __future__ import annotations

from oracles import html as H
from oracles.dialect import DUCK
from pagemill.functions import sqltext as X
from pagemill.operators.responses import REASON
from pagemill.options import (DEFAULT, MSG_BAD_SCHEME, MSG_HTTP_STATUS, MSG_INVALID_URL, MSG_NO_URLS, MSG_NOT_HTML,
                              MSG_REDIRECT_NO_LOCATION, MSG_TIMEOUT, MSG_TOO_LARGE, MSG_TOO_MANY_REDIRECTS, STATUS_BUDGET_SUFFIX)
from pagemill.plans.catalog import IPV6_FORMS, TEST_MAX_BYTES, TEST_TIMEOUT_MS
from pagemill.sources import fixtures as FX


def _d(s: str) -> str:
    return DUCK.s(s)


def _fmt_duck(msg: str, *vals) -> str:
    parts = msg.split("{}")
    out = _d(parts[0])
    for v, p in zip(vals, parts[1:]):
        out += f" || {v} || {_d(p)}"
    return out


REQ = f"({FX.duck(FX.REQUESTS_SQL)})"
RUNS = f"({FX.duck(FX.RUNS_SQL)})"
RESP = f"({FX.duck(FX.RESPONSES_SQL)})"
DNS = f"({FX.duck(FX.DNS_SQL)})"
RANGES = f"({FX.duck(FX.REFUSED_RANGES_SQL)})"
ADDR = f"({FX.duck(FX.ADDRESSES_SQL)})"

CLEAN = f"(SELECT run_id, ord, {X.js_trim(DUCK, 'coalesce(raw_url, ' + chr(39) * 2 + ')')} AS url FROM {REQ} r)"
CLEAN_F = f"(SELECT run_id, ord, url FROM {CLEAN} c WHERE url <> '')"
UNIQUE = f"(SELECT run_id, url, min(ord) AS ord FROM {CLEAN_F} c GROUP BY run_id, url)"

REASONS = "(CASE status " + " ".join(
    f"WHEN {k} THEN {_d(v)}" for k, v in sorted(REASON.items())) + " ELSE '' END)"


def _duck_norm(src: str) -> str:
    """Fixture-level URL normalisation in DuckDB (scheme/host lower-cased, default port dropped,
    empty path -> '/'); the Spark side is the full WHATWG-style expression chain."""
    t = X.js_trim(DUCK, "coalesce(raw_url, '')")
    return f"""(SELECT *, CASE WHEN valid AND scheme IN ('http','https','ftp','ws','wss','file')
        THEN scheme || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || rest END AS href,
        CASE WHEN scheme <> '' THEN scheme || ':' END AS protocol
     FROM (SELECT *, scheme <> '' AND (scheme NOT IN ('http','https','ftp','ws','wss','file') OR
                  (host <> '' AND NOT regexp_matches(host, '[\\x00-\\x20#%/:<>?@\\[\\\\\\]^|]'))) AS valid
           FROM (SELECT *, regexp_extract(after, '^([^/?#:]*)', 1) AS host,
                        regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path,
                        regexp_extract(after, '^[^/?#]*[^?#]*(.*)$', 1) AS rest
                 FROM (SELECT *, regexp_replace(substring(s, length(scheme) + 2), '^[/\\\\]*', '') AS after
                       FROM (SELECT *, lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme
                             FROM (SELECT *, {t} AS s FROM {src} z) a) b) c) d) e)"""


def _fetch_outcomes_duck() -> str:
    norm = _duck_norm(f"(SELECT run_id, ord, url AS raw_url, url FROM {UNIQUE} u)")
    err = (f"CASE WHEN NOT valid THEN {_fmt_duck(MSG_INVALID_URL, 'url')} "
           f"WHEN protocol NOT IN ('http:', 'https:') THEN {_fmt_duck(MSG_BAD_SCHEME, 'protocol')} "
           f"WHEN status IS NULL THEN 'Could not reach the page: no captured response.' "
           f"WHEN NOT (status BETWEEN 200 AND 299) THEN {_fmt_duck(MSG_HTTP_STATUS, 'CAST(status AS VARCHAR)', REASONS, 'href')} "
           f"WHEN NOT (coalesce(content_type, '') = '' OR regexp_matches(content_type, '(?i)text/html|application/xhtml')) "
           f"THEN {_fmt_duck(MSG_NOT_HTML, 'content_type')} "
           f"WHEN nbytes > {TEST_MAX_BYTES} THEN {_d(MSG_TOO_LARGE.format(TEST_MAX_BYTES))} END")
    return (f"(SELECT run_id, ord, CASE WHEN e IS NULL THEN href ELSE url END AS url, e AS error FROM "
            f"(SELECT n.*, {err} AS e FROM {norm} n LEFT JOIN (SELECT req_url, status, content_type, octet_length(encode(body)) AS nbytes "
            f"FROM {RESP} rr) r ON n.href = r.req_url) x)")


OUTCOMES = _fetch_outcomes_duck()
DELIVERED = (f"(SELECT o.run_id, o.ord, o.url, o.error FROM (SELECT o.*, coalesce(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) "
             f"OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {OUTCOMES} o) o "
             f"LEFT JOIN {RUNS} ru ON o.run_id = ru.run_id WHERE ru.event_limit IS NULL OR before < greatest(ru.event_limit, 1))")
SUMMARY = (f"(SELECT ru.run_id, CAST(coalesce(s, 0) AS BIGINT) AS succeeded, CAST(coalesce(f, 0) AS BIGINT) AS failed, "
           f"(ru.event_limit IS NOT NULL AND coalesce(s, 0) >= greatest(ru.event_limit, 1)) AS budget_reached FROM {RUNS} ru LEFT JOIN "
           f"(SELECT run_id, count(CASE WHEN error IS NULL THEN 1 END) AS s, count(CASE WHEN error IS NOT NULL THEN 1 END) AS f "
           f"FROM {DELIVERED} d GROUP BY run_id) g ON ru.run_id = g.run_id)")
VALIDATE = (f"(SELECT ru.run_id, CAST(coalesce(n, 0) AS BIGINT) AS n_urls, CASE WHEN coalesce(n, 0) = 0 THEN {_d(MSG_NO_URLS)} END AS error "
            f"FROM {RUNS} ru LEFT JOIN (SELECT run_id, count(*) AS n FROM {UNIQUE} u GROUP BY run_id) c ON ru.run_id = c.run_id)")

RECURSIVE_CHAIN = f"""WITH RECURSIVE resp AS (SELECT req_url, status, location, elapsed_ms FROM {RESP} r),
h(src, cur, hop, elapsed, status, location) AS (
  SELECT p.url, p.url, 0, coalesce(r.elapsed_ms, 0), r.status, r.location FROM pages p LEFT JOIN resp r ON r.req_url = p.url
  UNION ALL
  SELECT h.src, h.location, h.hop + 1, h.elapsed + coalesce(r.elapsed_ms, 0), r.status, r.location
  FROM h LEFT JOIN resp r ON r.req_url = h.location
  WHERE h.status BETWEEN 300 AND 399 AND coalesce(h.location, '') <> '' AND h.hop < 5 AND h.elapsed <= {{limit}}),
f AS (SELECT src, max(hop) AS mh FROM h GROUP BY src)
SELECT h.src, h.cur AS final_url, CAST(h.hop AS BIGINT) AS hops, h.status, CAST(h.elapsed AS BIGINT) AS elapsed,
  CASE WHEN h.status IS NULL THEN 'Could not reach the page: no captured response.'
       WHEN h.elapsed > {{limit}} THEN {_d(MSG_TIMEOUT.format(TEST_TIMEOUT_MS))}
       WHEN h.status BETWEEN 300 AND 399 AND coalesce(h.location, '') = '' THEN {_fmt_duck(MSG_REDIRECT_NO_LOCATION, 'CAST(h.status AS VARCHAR)')}
       WHEN h.status BETWEEN 300 AND 399 AND h.hop >= 5 THEN {_d(MSG_TOO_MANY_REDIRECTS.format(5))} END AS chain_error
FROM h JOIN f ON h.src = f.src AND h.hop = f.mh"""


def dotted(n: str) -> str:
    return " || '.' || ".join(f"CAST({n} // {256 ** k} % 256 AS VARCHAR)" for k in (3, 2, 1, 0))


def number(ip: str) -> str:
    """A dotted quad as a number, NULL for other text."""
    return "(" + " + ".join(f"TRY_CAST(split_part({ip}, '.', {4 - k}) AS BIGINT) * {256 ** k}" for k in (3, 2, 1, 0)) + ")"


VERDICTS = (
    "WITH hs AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1) AS host FROM pages), "
    f"j AS (SELECT hs.host, d.seq, d.address, {number('d.address')} AS n FROM hs LEFT JOIN {DNS} d ON hs.host = d.host), "
    f"g AS (SELECT j.host, count(j.seq) AS n_rows, arg_min(j.address, CASE WHEN r.cidr IS NOT NULL THEN j.seq END) AS bad FROM j LEFT JOIN {RANGES} r ON j.n BETWEEN r.lo AND r.hi GROUP BY j.host) "
    "SELECT host, CASE WHEN n_rows = 0 THEN 'Could not resolve the host \"' || host || '\".' "
    "WHEN bad IS NOT NULL THEN 'Refusing to fetch \"' || host || '\" because it resolves to a private or internal address (' || bad || ').' END AS verdict FROM g")

# Each hop is judged before it is fetched: a chain ends at the first URL whose host is refused.
CHECKED_CHAIN = f"""WITH RECURSIVE resp AS (SELECT req_url, status, location FROM {RESP} r), v AS ({VERDICTS}),
node AS (SELECT u.url, r.status, r.location, v.verdict FROM (SELECT url FROM pages UNION SELECT location FROM resp WHERE coalesce(location, '') <> '') u
  LEFT JOIN resp r ON r.req_url = u.url LEFT JOIN v ON v.host = regexp_extract(u.url, '^[a-z]+://([^:/?#]*)', 1)),
h(src, cur, hop, status, location, verdict) AS (
  SELECT url, url, 0, status, location, verdict FROM node WHERE url IN (SELECT url FROM pages)
  UNION ALL
  SELECT h.src, n.url, h.hop + 1, n.status, n.location, n.verdict FROM h JOIN node n ON n.url = h.location
  WHERE h.verdict IS NULL AND h.status BETWEEN 300 AND 399 AND h.hop < 5)
SELECT src, cur AS final_url, CAST(hop AS BIGINT) AS hops,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN status IS NULL THEN 'Could not reach the page: no captured response.'
       WHEN status BETWEEN 300 AND 399 AND coalesce(location, '') = '' THEN {_fmt_duck(MSG_REDIRECT_NO_LOCATION, 'CAST(status AS VARCHAR)')}
       WHEN status BETWEEN 300 AND 399 AND hop >= 5 THEN {_d(MSG_TOO_MANY_REDIRECTS.format(5))} END AS chain_error
FROM h QUALIFY row_number() OVER (PARTITION BY src ORDER BY hop DESC) = 1"""

# One token a step: the open containers are a list; an end tag takes its element and all after it off the list.
ELEMENT_TREE = f"""WITH RECURSIVE t AS (
  SELECT page_id, pos, tag, kind, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k
  FROM ({H.stages_sql(H.html_tokens_stages, source=f'({FX.duck(FX.UNCLOSED_SQL)})')}) x
  WHERE tag IN ('body', 'div', 'section', 'article', 'main', 'nav', 'ul', 'footer') AND kind IN ('open', 'close')),
w(page_id, k, pos, tag, opened, places, tags, gone) AS (
  SELECT page_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', FALSE, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT page_id FROM t)
  UNION ALL
  SELECT page_id, k, pos, tag, o, CASE WHEN o THEN list_append(places, pos) WHEN spot > 0 THEN places[1 : spot - 1] ELSE places END,
         CASE WHEN o THEN list_append(tags, tag) WHEN spot > 0 THEN tags[1 : spot - 1] ELSE tags END, CASE WHEN spot > 0 AND NOT o THEN places[spot:] ELSE [] END
  FROM (SELECT t.page_id, t.k, t.pos, t.tag, t.kind = 'open' AS o, w.places, w.tags,
               coalesce(len(w.tags) + 1 - list_position(list_reverse(w.tags), t.tag), 0) * CASE WHEN list_contains(w.tags, t.tag) THEN 1 ELSE 0 END AS spot
        FROM w JOIN t ON t.page_id = w.page_id AND t.k = w.k + 1) s),
held AS (SELECT page_id, pos, tag, places[1 : len(places) - 1] AS around, tags[1 : len(tags) - 1] AS around_tags FROM w WHERE opened AND tag NOT IN ('nav', 'ul', 'footer')),
outer_ AS (SELECT * FROM held WHERE NOT (tag IN ('article', 'main') AND (list_contains(around_tags, 'article') OR list_contains(around_tags, 'main')))),
ends AS (SELECT page_id, unnest(gone) AS began, pos AS end_pos FROM w)
SELECT o.page_id, CASE WHEN o.tag IN ('article', 'main') THEN 'region' ELSE 'container' END AS kind, o.pos, e.end_pos,
       (SELECT max(p.pos) FROM outer_ p WHERE p.page_id = o.page_id AND list_contains(o.around, p.pos)) AS parent_pos
FROM outer_ o LEFT JOIN ends e ON e.page_id = o.page_id AND e.began = o.pos"""


def oracles() -> dict:
    trim = X.js_trim(DUCK, "text")
    o = {
        "js_trim": f"SELECT doc_id, {trim} AS trimmed FROM documents",
        "word_count": f"SELECT doc_id, {X.word_count(DUCK, 'text')} AS words FROM documents",
        "tidy_markdown": f"SELECT doc_id, {X.tidy(DUCK, 'text')} AS tidy FROM documents",
        "clean_pages": H.clean_pages_duck(),
        "page_markdown": f"SELECT page_id, markdown, word_count FROM ({H.clean_pages_duck()}) q",
        "clean_pages_nolinks": f"SELECT page_id, markdown, word_count FROM ({H.clean_pages_duck(DEFAULT.with_(include_links=False))}) q",
        "render_document": (
            "SELECT page_id, concat_ws(chr(10), CASE WHEN coalesce(title, '') <> '' THEN '# ' || title END, "
            "CASE WHEN coalesce(site_name, '') <> '' THEN '**Source:** ' || site_name END, '**URL:** ' || url, "
            f"'**Words:** ' || CAST(word_count AS VARCHAR)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown AS document "
            f"FROM ({H.clean_pages_duck()}) q"),
        "html_tokens": H.stages_sql(H.html_tokens_stages),
        "remove_elements": H.stages_sql(H._remove_elements),
        "strip_chrome": H.stages_sql(H.strip_chrome_stages),
        "block_features": H.stages_sql(H._block_features),
        "link_table": H.stages_sql(H.link_table_stages),
        "resolve_links": H.stages_sql(H.link_table_stages, "page_id, pos, abs_href"),
        "neighbour_blocks": H.stages_sql(H._neighbours),
        "container_scores": H.stages_sql(H._containers),
        "extract_article": H.stages_sql(H._extract_article),
        "content_or_fallback": H.stages_sql(H._content_or_fallback),
        "md_blocks": H.stages_sql(H._md_blocks),
        "page_metadata": H.stages_sql(H._meta),
        "host_of": "SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?(\\[[^\\]]*\\]|[^:/?#]*)', 1), '^\\[|\\]$', '', 'g') AS host FROM pages",
        "private_ipv4": (f"SELECT a.id, {dotted('n')} AS ip, r.cidr IS NOT NULL AS private FROM {ADDR} a LEFT JOIN {RANGES} r ON a.n BETWEEN r.lo AND r.hi"),
        "private_ipv6": (
            f"WITH a AS (SELECT id, n, {dotted('n')} AS ip4 FROM {ADDR} x), "
            f"v AS (SELECT id, {IPV6_FORMS.replace('AS STRING', 'AS VARCHAR')} AS ip6 FROM a), "
            f"m AS (SELECT id, ip6, lower(ip6) AS l, {number("regexp_extract(lower(ip6), '^::ffff:([0-9.]+)$', 1)")} AS n FROM v) "
            f"SELECT id, ip6, (l IN ('::1', '::') OR r.cidr IS NOT NULL OR starts_with(l, 'fe80') OR starts_with(l, 'fc') OR starts_with(l, 'fd')) AS private "
            f"FROM m LEFT JOIN {RANGES} r ON m.n BETWEEN r.lo AND r.hi"),
        "distinct_urls": f"SELECT DISTINCT url FROM {CLEAN_F} c",
        "refused_ranges": f"SELECT a.id, a.n, r.cidr FROM {ADDR} a LEFT JOIN {RANGES} r ON a.n BETWEEN r.lo AND r.hi",
        "normalise_url": f"SELECT run_id, ord, href, protocol, valid FROM {_duck_norm(REQ)} q",
        "scheme_filter": f"SELECT run_id, ord, valid, (coalesce(valid, FALSE) AND coalesce(protocol IN ('http:', 'https:'), FALSE)) AS allowed FROM {_duck_norm(REQ)} q",
        "clean_requests": f"SELECT run_id, ord, url FROM {CLEAN_F} c",
        "first_seen": f"SELECT run_id, ord, url FROM {UNIQUE} u",
        "validate_runs": f"SELECT * FROM {VALIDATE} v",
        "request_options": (f"SELECT u.run_id, u.ord, coalesce(ru.include_links, TRUE) AS include_links, ru.event_limit, "
                            f"CASE WHEN coalesce(ru.render_js, FALSE) THEN 'page-rendered' ELSE 'page-scraped' END AS event_name "
                            f"FROM {UNIQUE} u JOIN {RUNS} ru ON u.run_id = ru.run_id"),
        "assemble_body": (f"SELECT req_url, CAST(sum(octet_length(encode(chunk))) AS BIGINT) AS total_bytes, "
                          f"CASE WHEN sum(octet_length(encode(chunk))) > {TEST_MAX_BYTES} THEN NULL ELSE string_agg(chunk, '' ORDER BY seq) END AS body, "
                          f"CASE WHEN sum(octet_length(encode(chunk))) > {TEST_MAX_BYTES} THEN {_d(MSG_TOO_LARGE.format(TEST_MAX_BYTES))} END AS error "
                          f"FROM ({FX.CHUNKS_DUCK_SQL}) c GROUP BY req_url"),
        "size_cap": f"SELECT req_url, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, octet_length(encode(body)) > {TEST_MAX_BYTES} AS too_large FROM {RESP} r",
        "status_filter": (f"SELECT req_url, status, status BETWEEN 200 AND 299 AS ok, CASE WHEN NOT (status BETWEEN 200 AND 299) "
                          f"AND NOT (status BETWEEN 300 AND 399) THEN {_fmt_duck(MSG_HTTP_STATUS, 'CAST(status AS VARCHAR)', REASONS, 'req_url')} END AS error FROM {RESP} r"),
        "content_type_filter": (f"SELECT req_url, (coalesce(content_type, '') = '' OR regexp_matches(content_type, '(?i)text/html|application/xhtml')) AS ok, "
                                f"CASE WHEN NOT (coalesce(content_type, '') = '' OR regexp_matches(content_type, '(?i)text/html|application/xhtml')) "
                                f"THEN {_fmt_duck(MSG_NOT_HTML, 'content_type')} END AS error FROM {RESP} r"),
        "resolve_redirects": "SELECT src, final_url, hops, status, chain_error FROM (" + RECURSIVE_CHAIN.replace("{limit}", "9223372036854775807") + ") q",
        "timeout_filter": "SELECT src, hops, elapsed, chain_error FROM (" + RECURSIVE_CHAIN.replace("{limit}", str(TEST_TIMEOUT_MS)) + ") q",
        "first_error": f"SELECT * FROM {OUTCOMES} o",
        "dataset_union": f"SELECT run_id, ord, url, error FROM {OUTCOMES} o",
        "budget_cutoff": f"SELECT run_id, ord, error FROM {DELIVERED} d",
        "unprocessed": f"SELECT u.run_id, u.ord FROM {UNIQUE} u ANTI JOIN {DELIVERED} d ON u.run_id = d.run_id AND u.ord = d.ord",
        "run_summary": f"SELECT * FROM {SUMMARY} s",
        "run_status": (f"SELECT s.run_id, coalesce(v.error, 'Done. Scraped ' || CAST(succeeded AS VARCHAR) || ' page(s), ' || CAST(failed AS VARCHAR) "
                       f"|| ' failed' || CASE WHEN budget_reached THEN {_d(STATUS_BUDGET_SUFFIX)} ELSE '.' END) AS status "
                       f"FROM {SUMMARY} s LEFT JOIN {VALIDATE} v ON s.run_id = v.run_id"),
        "meter_events": (f"SELECT d.run_id, CASE WHEN coalesce(ru.render_js, FALSE) THEN 'page-rendered' ELSE 'page-scraped' END AS event_name, "
                         f"count(*) AS n FROM {DELIVERED} d JOIN {RUNS} ru ON d.run_id = ru.run_id WHERE d.error IS NULL GROUP BY 1, 2"),
        "meter_hourly": "SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "host_verdicts": VERDICTS,
        "checked_redirects": CHECKED_CHAIN,
        "element_tree": ELEMENT_TREE,
        "rich_markdown": f"SELECT page_id, markdown, word_count FROM ({H.clean_pages_duck(source='(' + FX.duck(FX.RICH_SQL) + ')')}) q",
        "tripping_chunk": (f"SELECT req_url, CAST(max(received) AS BIGINT) AS total_bytes, min(CASE WHEN received > {TEST_MAX_BYTES} THEN seq END) AS trip_seq FROM "
                           f"(SELECT req_url, seq, sum(octet_length(encode(chunk))) OVER (PARTITION BY req_url ORDER BY seq) AS received FROM ({FX.CHUNKS_DUCK_SQL}) c) x GROUP BY req_url"),
    }
    return o
