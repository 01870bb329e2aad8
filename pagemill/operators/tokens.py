"""HTML as token arrays.

A page stays one row: its tokens are an array, and what the fold of ``operators.tree`` says
about them is another beside it, so the page rows cross one shuffle and nothing is sorted. Texts, attributes and
links are computed by array functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import sqltext as X
from pagemill.functions.dialect import SPARK as D
from pagemill.functions.steps import step
from pagemill.operators import tree as T
from pagemill.options import DEFAULT, Options
from pagemill.session import bounded_batches

# Token grammar: tags (quoted '>' stays inside), declarations/comments, text runs, stray '<'.
# Possessive quantifiers keep Java's regex engine from deep backtracking/recursion on long tags.
TOKEN_RE = "</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*+>|[^<]++|<"
TAG_NAME_RE = "^<(/?[A-Za-z][A-Za-z0-9:-]*)"
PLACEHOLDER = "<x-removed>"


def in_list(col: str, values) -> str:
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


# --- G2 -------------------------------------------------------------------
RAW_TEXT_TAGS = ("script", "style", "iframe")


def clean_html(x: str, opts: Options = DEFAULT) -> str:
    """Normalise newlines and replace comments and removed elements (script, style, noscript, iframe, form) by an
    empty placeholder tag.

    Done on the string *before* tokenising because raw-text elements may hold tag-like text
    (``var t="</p>"``). Comments and raw text go in one pass from the left, so that neither hides in the other, and
    run to the end if unclosed; then the other removed elements go, and one that is never closed is left to the
    tree. The placeholder keeps "the body had markup" observable for the blank-content rule while rendering nothing."""
    raw = "|".join(t for t in RAW_TEXT_TAGS if t in opts.removed_tags)
    other = "|".join(t for t in opts.removed_tags if t not in RAW_TEXT_TAGS)
    x = f"(CASE WHEN instr({x}, {D.s(chr(13))}) > 0 THEN {D.rx_replace(x, chr(13) + chr(10) + '?', chr(10))} ELSE {x} END)"
    x = D.rx_replace(x, "(?s)<(?:!--.*?(?:-->|\\z)" + (f"|(?i:({raw}))\\b[^>]*+>.*?(?:</(?i:\\1)\\s*>|\\z)" if raw else "") + ")", PLACEHOLDER)
    return D.rx_replace(x, f"(?is)<({other})\\b[^>]*+>.*?</\\1\\s*>", PLACEHOLDER) if other else x


# Target HTML bytes per page partition. A page's arrays expand its HTML a few times in memory, one page at a time.
TARGET_PARTITION_BYTES = 64 * 1024 * 1024


def page_partition_count(pages: DataFrame, opts: Options = DEFAULT) -> int:
    """Explicit partition count for the page shuffle: from options, else from the size
    of the input files (driver-side metadata only), never below the cluster parallelism.
    An explicit count also stops AQE from coalescing this CPU-heavy stage into a few tasks."""
    if opts.page_partitions:
        return int(opts.page_partitions)
    spark = pages.sparkSession
    floor_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaf.stats().sizeInBytes())) for leaf in (leaves.apply(i) for i in range(leaves.size()))]
    size = sum(s for s in sizes if s < 1 << 60)  # an unknown size is given as the largest number
    return max(floor_, -(-size // TARGET_PARTITION_BYTES))


def partition_pages(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Hash-partition the *page rows* on page_id: the one exchange of the HTML plans."""
    return pages.repartition(page_partition_count(pages, opts), "page_id")


def with_links_flag(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Ensure the per-page ``lnk`` (include links) column; default from the options."""
    if "lnk" in pages.columns:
        return pages.select("page_id", "url", "html", F.coalesce(F.col("lnk"), F.lit(opts.include_links)).alias("lnk"))
    return pages.select("page_id", "url", "html", F.lit(opts.include_links).alias("lnk"))


# --- G1 -------------------------------------------------------------------
def tokenised(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """pages(page_id, url, html[, lnk]) -> page rows with ``toks`` and ``names`` (lower-case tag name, '/name' for end
    tags, '' for text and declarations)."""
    p = partition_pages(with_links_flag(pages, opts), opts)
    p = p.selectExpr("page_id", "url", "lnk", f"{clean_html('html', opts)} AS h")
    p = step(p, toks=f"coalesce({D.rx_extract_all('h', TOKEN_RE)}, array())").drop("h")
    return step(p, names=f"transform(toks, t -> CASE WHEN startswith(t, '<') THEN lower({D.rx_extract('t', TAG_NAME_RE, 1)}) ELSE '' END)")


def marks_sql(opts: Options = DEFAULT) -> str:
    """What the fold sees of each token: 't' text, 'n' text of other white space, ' ' blank, '!' a declaration,
    else the tag name; ':1' marks an anchor or image with a target and a checkbox, ':n' a list's start."""
    has = lambda name: f"{X.js_trim(D, X.raw_attr(D, 't', name))} <> ''"
    start = f"trim({X.raw_attr(D, 't', 'start')})"
    checkbox = f"lower({X.raw_attr(D, 't', 'type')}) = 'checkbox'" if opts.has("task") else "FALSE"
    return (
        "zip_with(toks, names, (t, m) -> CASE "
        f"WHEN m = '' THEN (CASE WHEN startswith(t, '<') AND length(t) > 1 THEN '!' WHEN btrim(t, {D.s(' ' + chr(9) + chr(10) + chr(13) + chr(12))}) = '' THEN ' ' WHEN {X.js_trim(D, 't')} = '' THEN 'n' ELSE 't' END) "
        f"WHEN m = 'a' AND {has('href')} THEN 'a:1' WHEN m = 'img' AND {has('src')} THEN 'img:1' "
        f"WHEN m = 'input' AND {checkbox} THEN 'input:1' "
        f"WHEN m = 'ol' AND {D.rlike(start, '^-?[0-9]{1,9}$')} THEN concat('ol:', {start}) ELSE m END)"
    )


# --- E4 -------------------------------------------------------------------
def with_tree(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Page rows with ``toks``, ``names`` and the arrays of the tree (``tokens``, ``blocks``, ``spans``, ``refs``, ...).

    The arrays take many times the page's bytes in a Python worker, so its batches are bounded."""
    bounded_batches(pages.sparkSession)
    p = tokenised(pages, opts).withColumn("marks", F.expr(marks_sql(opts)))
    p = p.withColumn("tree", T.page_trees(opts)(F.col("marks")))
    return p.selectExpr("page_id", "url", "lnk", "toks", "names", "tree.*")


def with_texts(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Adds ``txts`` (decoded text of text tokens outside the head; raw inside pre, collapsed elsewhere) and
    ``hrefs`` (the target of each of ``refs``, trimmed, as written) and ``links`` (resolved)."""
    attr = f"CASE WHEN r.n = 0 THEN {X.raw_attr(D, 'toks[r.pos]', 'src')} ELSE {X.raw_attr(D, 'toks[r.pos]', 'href')} END"
    p = step(with_tree(pages, opts),
             txts=f"zip_with(toks, tokens, (x, c) -> CASE WHEN c.k IN ({T.TEXT}, {T.CODE_TEXT}, {T.RAW}) THEN {X.decode_entities(D, 'x')} END)",
             hrefs=f"transform(refs, r -> {attr})")
    p = step(p, txts=f"zip_with(txts, tokens, (x, c) -> CASE WHEN c.k = {T.RAW} THEN x ELSE {X.collapse_ws(D, 'x')} END)",
             hrefs=f"transform(hrefs, h -> {X.js_trim(D, X.decode_entities(D, 'h', attribute=True))})")
    return step(p, links="hrefs" if opts.compat else f"transform(hrefs, h -> {X.resolve_url(D, 'url', 'h')})")


# --- query shapes: G1 / G3 / G10 ------------------------------------------------
def html_tokens(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """G1: one row per token with tag and direction."""
    rows = tokenised(pages, opts).selectExpr("page_id", "posexplode(arrays_zip(toks, names)) AS (pos, t)")
    return rows.selectExpr(
        "page_id", "CAST(pos AS BIGINT) AS pos", "t.toks AS tok", "ltrim('/', t.names) AS tag",
        "CASE WHEN startswith(t.names, '/') THEN 'close' WHEN t.names <> '' THEN 'open' WHEN t.toks RLIKE '^<[!?]' THEN 'decl' ELSE 'text' END AS kind")


def strip_chrome(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Body tokens outside nav/header/footer/aside subtrees, with depth context."""
    rows = with_tree(pages, opts).selectExpr("page_id", "posexplode(arrays_zip(toks, names, tokens)) AS (pos, t)")
    rows = rows.selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "t.toks AS tok", "ltrim('/', t.names) AS tag", "t.tokens AS c")
    return rows.where(f"(c.f & {T.EXCLUDED | T.CHROME}) = 0 AND NOT {in_list('tag', opts.chrome_tags)}").selectExpr(
        "page_id", "pos", "tok", "tag", "CAST(c.lvl AS BIGINT) AS depth", f"(c.f & {T.IN_LINK}) > 0 AS in_link")


def link_table(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """G10 + G8: every <a> outside <head>: (page_id, pos, href, abs_href, text)."""
    p = with_texts(pages, opts).selectExpr("page_id", "inline(transform(refs, (r, i) -> named_struct('n', r.n, 'pos', CAST(r.pos AS BIGINT), 'href', hrefs[i], "
                                           "'abs_href', links[i], 'text', array_join(slice(txts, r.pos + 1, r.n), ''))))")
    return p.where("n > 0").selectExpr("page_id", "pos", "href", "abs_href", f"{X.js_trim(D, D.rx_replace('text', ' +', ' '))} AS text")


def element_tree(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """The containers and outermost regions of each page: the tokens where they begin and end (NULL: with the page), and the one around them."""
    return with_tree(pages, opts).selectExpr("page_id", "inline(transform(spans, s -> named_struct('kind', s.kind, 'pos', CAST(s.pos AS BIGINT), "
                                             "'end_pos', CAST(s.`end` AS BIGINT), 'parent_pos', CASE WHEN s.parent >= 0 THEN CAST(spans[s.parent].pos AS BIGINT) END)))")
