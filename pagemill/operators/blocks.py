"""Blocks, article isolation and page assembly.

A page's blocks are one array of structs on the page's row. Neighbours are array elements, sums
inside a container are differences of running sums, and the page is its kept blocks joined: no
window, no sort and no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pagemill.functions import sqltext as X
from pagemill.functions.dialect import SPARK as D
from pagemill.functions.steps import step
from pagemill.operators.markdown import BULLET, fenced, finish_inline, fragments_sql, indent_lines
from pagemill.operators.tokens import with_texts
from pagemill.operators.tree import IN_LINK, RAW
from pagemill.options import DEFAULT, Options

BLOCK_FIELDS = ("blk", "first", "n", "s_tag", "s_dir", "chrome", "region", "q", "list", "li", "num", "h", "pre", "tbl", "row", "cells", "code")
#: Words of each text: a collapsed ASCII text has one more than its inner spaces.
WORDS = ("zip_with(txts, tokens, (x, c) -> CASE WHEN x IS NULL OR x = ' ' THEN 0L "
         f"WHEN c.k <> {RAW} AND octet_length(x) = length(x) AND instr(x, {D.s(chr(11))}) = 0 "
         f"THEN CAST(1 + length(btrim(x)) - length(replace(btrim(x), ' ', '')) AS BIGINT) ELSE {X.word_count(D, 'x')} END)")


@F.arrow_udf(ArrayType(LongType()))
def running_sums(values: pa.Array) -> pa.Array:
    """Running sums of each array."""
    flat = np.concatenate([[0], np.cumsum(values.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    offsets = np.concatenate([[0], np.cumsum(np.array([len(v) if v is not None else 0 for v in values], np.int64))])
    sizes = np.diff(offsets)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[1:] - np.repeat(flat[offsets[:-1]], sizes), pa.int64()))


def _struct(fields, source: str = "b") -> str:
    return ", ".join(f"'{f}', {source}.{f}" for f in fields)


# --- D7 -------------------------------------------------------------------
def with_blocks(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Adds ``bl``: the blocks with their context, Markdown fragment, plain text, word and link features."""
    p = step(with_texts(pages, opts), words=WORDS, frags=fragments_sql(opts))
    p = step(p, lwords=f"zip_with(words, tokens, (w, c) -> CASE WHEN (c.f & {IN_LINK}) > 0 THEN w ELSE 0L END)")
    part = lambda a: f"slice({a}, b.first + 1, b.n)"
    total = lambda a: f"aggregate({part(a)}, 0L, (s, v) -> s + v)"
    lang = D.rx_extract(X.attr(D, "toks[b.code]", "class"), "(?:^|\\s)(?:language|lang)-(\\S+)", 1)
    bl = (f"transform(blocks, b -> named_struct({_struct(BLOCK_FIELDS)}, 'lang', CASE WHEN b.code >= 0 THEN {lang} ELSE '' END, "
          f"'frag', array_join({part('frags')}, ''), 'plain', nullif(array_join({part('txts')}, ''), ''), "
          f"'words', {total('words')}, 'link_words', {total('lwords')}))")
    title = "CASE WHEN title.n > 0 THEN array_join(slice(toks, title.pos + 2, title.n - 1), '') ELSE '' END"
    return step(p, bl=bl, title_raw=title, metas="transform(metas, m -> toks[m])").select("page_id", "url", "bl", "spans", "markup", "title_raw", "metas")


# --- E5 / E6 / classification -----------------------------------------------
def with_neighbours(p: DataFrame) -> DataFrame:
    """Link density, previous/next non-empty block features (E5), list markers (E6) and the shallow-text
    boilerplate rule."""
    content = (
        "CASE WHEN b.words = 0 THEN FALSE WHEN b.ld > (1.0 / 3.0) THEN FALSE "
        "WHEN b.prev_ld <= (5.0 / 9.0) THEN (b.words > 16 OR b.next_words > 15 OR b.prev_words > 4) "
        "ELSE (b.words > 40 OR b.next_words > 17) END"
    )
    ld = lambda b: f"CASE WHEN {b}.words > 0 THEN CAST({b}.link_words AS DOUBLE) / {b}.words ELSE 0.0D END"
    marker = f"CASE WHEN b.num IS NULL THEN NULL WHEN b.num < 0 AND b.list > 0 OR b.list = 0 THEN {D.s(BULLET)} ELSE concat(CAST(b.num AS STRING), '.  ') END"
    held = (*BLOCK_FIELDS, "lang", "frag", "plain", "words", "link_words")
    p = step(p, full="filter(bl, b -> b.words > 0)").withColumn("upto", running_sums(F.expr("transform(bl, b -> CASE WHEN b.words > 0 THEN 1L ELSE 0L END)")))
    before = "CAST(upto[i] - CASE WHEN b.words > 0 THEN 1 ELSE 0 END AS INT)"
    prev, following = f"get(full, {before} - 1)", "get(full, CAST(upto[i] AS INT))"
    p = step(p, bl=f"transform(bl, (b, i) -> named_struct({_struct(held)}, 'ld', {ld('b')}, 'prev_words', coalesce({prev}.words, 0L), "
                   f"'prev_ld', coalesce({ld(prev)}, 0.0D), 'next_words', coalesce({following}.words, 0L), 'marker', {marker}))")
    return step(p, bl=f"transform(bl, b -> named_struct({_struct((*held, 'ld', 'prev_words', 'next_words', 'marker'))}, 'is_content', {content}))").drop("full", "upto")


# --- D8 / F3 / G4 ---------------------------------------------------------
def with_choice(p: DataFrame) -> DataFrame:
    """Winning article region (rule 1) or section/div/body container (rule 2) per page; container score =
    content words inside x (1 - link density inside), from running sums at its first block and its end.
    Adds ``scored`` (container blocks with their scores), ``region``, ``best``, ``source`` and ``kept``."""
    sums = {"cw": "CASE WHEN b.is_content AND NOT b.chrome THEN b.words ELSE 0L END", "w": "b.words", "lw": "b.link_words",
            "rw": "CASE WHEN b.region > 0 AND NOT b.chrome THEN b.words ELSE 0L END"}
    for name, value in sums.items():
        p = p.withColumn(f"s_{name}", running_sums(F.expr(f"transform(bl, b -> {value})")))
    upto = lambda name, at: f"(CASE WHEN {at} <= 0 THEN 0L ELSE s_{name}[{at} - 1] END)"
    inside = lambda name: f"({upto(name, 's.at_end')} - {upto(name, 's.at')})"
    p = step(p, placed="transform(spans, s -> named_struct('kind', s.kind, 'o', s.o, 'c', s.c, 'at', s.o - bl[0].blk, 'at_end', coalesce(s.c - bl[0].blk, size(bl))))")
    p = step(p, weighed="transform(placed, s -> named_struct('kind', s.kind, 'o', s.o, 'c', s.c, 'at', s.at, "
                        f"'cw', {inside('cw')}, 'w', {inside('w')}, 'lw', {inside('lw')}, 'rw', {inside('rw')}))")
    p = step(p, scored="transform(filter(weighed, s -> s.kind = 'container' AND s.cw > 0), s -> named_struct("
                       "'score', s.cw * (1.0D - CASE WHEN s.w > 0 THEN CAST(s.lw AS DOUBLE) / s.w ELSE 0.0D END), 'neg', -s.o, 'o', s.o, 'c', s.c))",
             region="array_max(transform(filter(weighed, s -> s.kind = 'region' AND s.rw > 0), s -> named_struct('w', s.rw, 'neg', -bl[s.at].region, 'r', bl[s.at].region))).r")
    p = step(p, best="array_max(scored)")
    p = step(p, source="CASE WHEN region IS NOT NULL THEN 'article' WHEN best IS NOT NULL THEN 'container' ELSE 'fallback' END")
    dense = "(b.h > 0 OR b.ld <= (1.0 / 3.0))"
    return step(p, kept=f"CASE source WHEN 'article' THEN filter(bl, b -> b.region = region AND NOT b.chrome AND {dense}) "
                        f"WHEN 'container' THEN filter(bl, b -> b.blk >= best.o AND (best.c IS NULL OR b.blk < best.c) AND NOT b.chrome AND {dense}) "
                        "ELSE filter(bl, b -> NOT b.chrome) END").drop("placed", "weighed", *[f"s_{n}" for n in sums])


# --- H1-H16 ---------------------------------------------------------------
def with_markdown(p: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Adds ``md``: (blk, lead, md) of each kept block that renders, lead being the separator before it."""
    nl = D.s("\n")
    in_pre, in_row = "(b.pre OR (b.s_tag = 'pre' AND b.s_dir = 1))", "((b.s_tag = 'tr' AND b.s_dir = 1) OR (b.tbl > 0 AND b.cells > 0))"
    if not opts.has("table"):
        in_row = "FALSE"
    held = ("blk", "q", "list", "li", "h", "tbl", "row", "cells", "marker")
    p = step(p, md=f"transform(kept, b -> named_struct({_struct(held)}, 'is_row', {in_row}, 'text', "
        f"CASE WHEN {in_pre} THEN (CASE WHEN length(b.frag) > 0 THEN {fenced('b.frag', 'b.lang')} ELSE '' END) ELSE {finish_inline('b.frag')} END))")
    rule = f"concat('| ', array_join(array_repeat('---', b.cells), ' | '), ' |')"
    line = f"concat({D.rx_replace('b.text', chr(10), ' ')}, ' |')"
    body = (f"CASE WHEN b.is_row THEN (CASE WHEN b.cells = 0 THEN '' WHEN b.row = 1 THEN concat({line}, {nl}, {rule}) ELSE {line} END) "
            "WHEN b.h > 0 AND b.text <> '' THEN concat(repeat('#', b.h), ' ', b.text) ELSE b.text END")
    held = (*held, "is_row")
    p = step(p, md=f"filter(transform(md, b -> named_struct({_struct(held)}, 'text', {body})), b -> b.text <> '')")
    # an item is the first block of its li: ids grow with the page, so a later block of an outer li has a smaller one
    p = step(p, md=f"transform(md, (b, i) -> named_struct({_struct((*held, 'text'))}, 'p', get(md, i - 1), "
                   "'is_item', b.list > 0 AND b.marker IS NOT NULL AND b.li > coalesce(get(md, i - 1).li, 0)))")
    pad = indent_lines("b.text", "b.list * 4")
    listed = (f"CASE WHEN b.is_item THEN concat(repeat(' ', (b.list - 1) * 4), b.marker, {pad}) "
              f"WHEN b.list > 0 THEN concat(repeat(' ', b.list * 4), {pad}) ELSE b.text END")
    lead = (f"CASE WHEN b.p IS NULL THEN '' WHEN b.is_row AND b.p.is_row AND b.p.tbl = b.tbl THEN {nl} "
            f"WHEN b.is_item AND b.p.list > 0 THEN {nl} "
            f"WHEN b.q > 0 AND b.p.q > 0 THEN concat({nl}, rtrim(repeat('> ', CAST(least(b.q, b.p.q) AS INT))), {nl}) ELSE {D.s(chr(10) * 2)} END")
    p = step(p, md=f"transform(md, b -> named_struct('blk', b.blk, 'lead', {lead}, 'q', b.q, 'md', {listed}))")
    quote = "repeat('> ', CAST(b.q AS INT))"
    return step(p, md=f"transform(md, b -> named_struct('blk', b.blk, 'lead', b.lead, 'md', CASE WHEN b.q > 0 THEN concat({quote}, replace(b.md, {nl}, concat({nl}, {quote}))) ELSE b.md END))")


# --- D9 / H17 / G5-G7 -----------------------------------------------------
def metadata(p: DataFrame) -> list[str]:
    """doc_title, meta_excerpt and site_name from the title and the metas before the body."""
    def meta(key_re: str) -> str:
        hit = D.filter("metas", "m", D.rlike("m", f"(?i)[\\s\"'](name|property)\\s*=\\s*[\"']?({key_re})[\"'\\s/>]"))
        return f"nullif({X.js_trim(D, X.attr(D, D.elem(hit, 1), 'content'))}, '')"

    return [
        f"{X.js_trim(D, X.collapse_ws(D, X.decode_entities(D, 'title_raw')))} AS doc_title",
        f"coalesce({meta('og:description')}, {meta('description')}, {meta('twitter:description')}) AS meta_excerpt",
        f"{meta('og:site_name')} AS site_name",
    ]


def assembled(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """One row per page: tidy Markdown, first paragraph text, source, any_markup and metadata."""
    p = with_markdown(with_choice(with_neighbours(with_blocks(pages, opts))), opts)
    first_p = "get(filter(kept, b -> b.s_tag = 'p' AND b.s_dir = 1 AND b.words > 0), 0).plain"
    joined = "array_join(transform(md, b -> concat(b.lead, b.md)), '')"
    p = p.selectExpr("page_id", "url", "source", "coalesce(markup, FALSE) AS any_markup", f"{first_p} AS first_p", f"{joined} AS raw_md", *metadata(p))
    return step(p, markdown=X.tidy(D, "coalesce(raw_md, '')")).drop("raw_md")


# --- query shapes -----------------------------------------------------------
def block_features(pages: DataFrame) -> DataFrame:
    return with_blocks(pages).selectExpr("page_id", "inline(bl)").selectExpr(
        "page_id", "CAST(blk AS BIGINT) AS blk", "s_tag", "words", "link_words", "plain")


def neighbour_blocks(pages: DataFrame) -> DataFrame:
    return with_neighbours(with_blocks(pages)).selectExpr("page_id", "inline(bl)").selectExpr(
        "page_id", "CAST(blk AS BIGINT) AS blk", "words", "prev_words", "next_words", "is_content", "CASE WHEN s_tag = 'li' AND s_dir = 1 THEN marker END AS li_marker")


def container_scores(pages: DataFrame) -> DataFrame:
    p = with_choice(with_neighbours(with_blocks(pages)))
    return p.selectExpr(
        "page_id", "inline(transform(bl, b -> named_struct('blk', CAST(b.blk AS BIGINT), 'cand_score', get(filter(scored, s -> s.o = b.blk), 0).score)))",
        "CAST(best.o AS BIGINT) AS c_open", "CAST(best.c AS BIGINT) AS c_close", "CAST(region AS BIGINT) AS win_region")


def extract_article(pages: DataFrame) -> DataFrame:
    p = with_choice(with_neighbours(with_blocks(pages)))
    return p.selectExpr("page_id", "source", "CAST(size(kept) AS BIGINT) AS kept_blocks", "aggregate(kept, 0L, (s, b) -> s + b.words) AS kept_words")


def content_or_fallback(pages: DataFrame) -> DataFrame:
    p = with_choice(with_neighbours(with_blocks(pages)))
    return p.selectExpr("page_id", "source", "CAST(coalesce(markup, FALSE) AS BIGINT) AS any_markup", "array_join(transform(kept, b -> b.plain), '') AS content_text")


def md_blocks(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Every block; lead and md are NULL where it isn't kept or renders nothing."""
    p = with_markdown(with_choice(with_neighbours(with_blocks(pages, opts))), opts)
    rest = "transform(array_except(transform(bl, b -> b.blk), transform(md, b -> b.blk)), x -> named_struct('blk', x, 'lead', CAST(NULL AS STRING), 'md', CAST(NULL AS STRING)))"
    return p.selectExpr("page_id", f"inline(concat(md, {rest}))").withColumn("blk", F.col("blk").cast("bigint"))


def page_metadata(pages: DataFrame) -> DataFrame:
    p = with_blocks(pages)
    return p.selectExpr("page_id", "url", *metadata(p))
