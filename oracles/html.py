"""The HTML queries in DuckDB SQL, by another method than the library's.

The library folds each page's tags with a stack. Here nesting is a running sum of +1 (open) and -1
(close) over token rows, blocks are groups, neighbours and sums are windows, and formatting is paired by
regular expressions over control characters. Both agree on pages whose containers are closed.
"""

from __future__ import annotations

from dataclasses import dataclass

from oracles.dialect import DUCK, Agg, Dialect, Explode, Sel, Where, all_w, duck_ctes, prev_w, run_w
from pagemill.functions import sqltext as X
from pagemill.options import DEFAULT, MSG_NO_CONTENT, Options

# Token grammar: tags (quoted '>' stays inside), declarations/comments, text runs, stray '<'.
# Possessive quantifiers keep Java's regex engine from deep backtracking/recursion on long tags.
TOKEN_RE = "</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*+>|[^<]++|<"
TAG_NAME_RE = "^</?([A-Za-z][A-Za-z0-9:-]*)"
PLACEHOLDER = "<x-removed>"

VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr", "x-removed")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Tags that start/end a block of text (p, li, td and friends may be left unclosed).
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog",
              "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
              "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol",
              "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul")
TABLE_STRUCT = ("table", "thead", "tbody", "tfoot", "tr")
CELL_TAGS = ("td", "th")
# Tags whose nesting level is tracked for open/close matching (containers and lists).
LEVEL_TAGS = ("body", "div", "section", "article", "main", "ul", "ol")
LIST_TAGS = ("ul", "ol")
REGION_TAGS = ("article", "main")

W = run_w("page_id", "pos")


def in_list(col: str, values) -> str:
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


# --- G2 -------------------------------------------------------------------
def clean_html(d: Dialect, x: str, opts: Options = DEFAULT) -> str:
    """Normalise newlines, drop control characters, and replace comments and removed elements
    (script, style, noscript, iframe, form) by an empty placeholder tag.

    Done on the string *before* tokenising because raw-text elements may hold tag-like text
    (``var t="</p>"``). The placeholder keeps "the body had markup" observable for the
    blank-content rule while rendering nothing. One pass per removed tag, in order."""
    x = d.rx_replace(x, "\r\n?", "\n")
    x = d.rx_replace(x, "[\\x00-\\x08\\x0B\\x0E-\\x1F]", "")
    x = d.rx_replace(x, "(?s)<!--.*?(?:-->|\\z)", PLACEHOLDER)
    for t in opts.removed_tags:
        end = f"(?:</{t}\\s*>|\\z)" if t in ("script", "style", "iframe") else f"</{t}\\s*>"  # raw text runs to the end if unclosed
        x = d.rx_replace(x, f"(?is)<{t}\\b[^>]*+>.*?{end}", PLACEHOLDER)
    return x


# --- G1 -------------------------------------------------------------------
def token_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """pages(page_id, url, html) -> tokens(page_id, url, tok, pos, tag, o, c, void, is_text)."""
    sw = d.startswith
    return [
        Sel(keep=["page_id", "url", "lnk"], cols=[("h", clean_html(d, "html", opts))]),
        Sel(keep=["page_id", "url", "lnk"], cols=[("toks", d.rx_extract_all("h", TOKEN_RE))]),
        Explode("toks", "pos0", "tok", keep=["page_id", "url", "lnk"]),
        Sel(keep=["page_id", "url", "lnk", "tok"], cols=[
            ("pos", "CAST(pos0 AS BIGINT)"),
            ("tag", f"lower({d.rx_extract('tok', TAG_NAME_RE, 1)})"),
        ]),
        Sel(cols=[
            ("o", f"CASE WHEN tag <> '' AND NOT {sw('tok', '</')} THEN 1 ELSE 0 END"),
            ("c", f"CASE WHEN tag <> '' AND {sw('tok', '</')} THEN 1 ELSE 0 END"),
            ("void", in_list("tag", VOID_TAGS)),
            ("is_text", f"(tag = '' AND NOT {d.rlike('tok', '^<[!?]')})"),
        ]),
    ]


def _delta(tags) -> str:
    return f"CASE WHEN {in_list('tag', tags)} AND NOT void THEN o - c ELSE 0 END"


# --- E4 -------------------------------------------------------------------
RUN_COUNTERS = ("chrome", "region", "a", "pre", "code", "q", "lvl", "list", "table", "h", "title")


def nesting_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """Depth counters (clamped at 0) and per-token context, all over one window spec."""
    tags = {
        "chrome": opts.chrome_tags, "region": REGION_TAGS, "a": ("a",), "pre": ("pre",), "code": ("code",),
        "q": ("blockquote",), "lvl": LEVEL_TAGS, "list": LIST_TAGS, "table": ("table",), "h": HEADINGS,
        "title": ("title",),
    }
    op, cl = "o = 1", "c = 1"
    attrs = Sel(cols=[
        ("href", f"CASE WHEN {op} AND tag = 'a' THEN {X.js_trim(d, X.attr(d, 'tok', 'href'))} END"),
        ("src", f"CASE WHEN {op} AND tag = 'img' THEN {X.js_trim(d, X.attr(d, 'tok', 'src'))} END"),
        ("alt", f"CASE WHEN {op} AND tag = 'img' THEN {X.attr(d, 'tok', 'alt')} END"),
        ("itype", f"CASE WHEN {op} AND tag = 'input' THEN lower({X.attr(d, 'tok', 'type')}) END"),
        ("checked", f"CASE WHEN {op} AND tag = 'input' THEN {X.has_attr(d, 'tok', 'checked')} END"),
        ("h_open", f"CASE WHEN {op} AND {in_list('tag', HEADINGS)} THEN CAST(substring(tag, 2, 1) AS INTEGER) END"),
        ("cls", f"CASE WHEN {op} AND tag = 'code' THEN {X.attr(d, 'tok', 'class')} END"),
        ("start_attr", f"CASE WHEN {op} AND tag = 'ol' THEN trim({X.attr(d, 'tok', 'start')}) END"),
    ])
    cell_state = (f"CASE WHEN {in_list('tag', CELL_TAGS)} AND {op} THEN TRUE "
                  f"WHEN {in_list('tag', TABLE_STRUCT)} OR ({in_list('tag', CELL_TAGS)} AND {cl}) THEN FALSE END")
    runs = [(f"r_{k}", f"sum({_delta(tags[k])}) {W}") for k in RUN_COUNTERS]
    runs += [
        ("head_open", f"max(CASE WHEN tag = 'head' AND {op} THEN 1 ELSE 0 END) {W}"),
        ("head_done", f"max(CASE WHEN (tag = 'head' AND {cl}) OR (tag = 'body' AND {op}) THEN 1 ELSE 0 END) {W}"),
        ("cur_href", f"{d.last_nn('href')} {W}"),
        ("h_level", f"{d.last_nn('h_open')} {W}"),
        ("in_cell", f"{d.last_nn(cell_state)} {W}"),
        ("n_cells", f"sum(CASE WHEN {in_list('tag', CELL_TAGS)} AND {op} THEN 1 ELSE 0 END) {W}"),
        ("n_rows", f"sum(CASE WHEN tag = 'tr' AND {op} THEN 1 ELSE 0 END) {W}"),
        ("table_seq", f"sum(CASE WHEN tag = 'table' AND {op} THEN 1 ELSE 0 END) {W}"),
        ("li_seq", f"sum(CASE WHEN tag = 'li' AND {op} THEN 1 ELSE 0 END) {W}"),
        ("after_hr", f"coalesce(lag(CASE WHEN tag = 'hr' AND {op} THEN TRUE END, 1) OVER (PARTITION BY page_id ORDER BY pos), FALSE)"),
    ]
    depths = [(f"d_{k}", f"r_{k} - least(0, min(r_{k}) {W})") for k in RUN_COUNTERS]
    depths += [
        ("cell_in_row", f"n_cells - {d.last_nn("CASE WHEN tag = 'tr' AND o = 1 THEN n_cells END")} {W}"),
        ("row_in_table", f"n_rows - {d.last_nn("CASE WHEN tag = 'table' AND o = 1 THEN n_rows END")} {W}"),
    ]
    boundary = (
        f"(({in_list('tag', BLOCK_TAGS)} AND o + c > 0 AND (d_pre = 0 OR tag = 'pre') "
        f"AND NOT (coalesce(in_cell, FALSE) AND NOT {in_list('tag', TABLE_STRUCT)})) OR after_hr)"
    )
    return [
        attrs,
        Sel(cols=runs),
        Sel(cols=depths),
        Sel(cols=[
            ("boundary", boundary),
            ("in_head", "((head_open = 1 AND head_done = 0) OR d_title > 0)"),
            ("region_start", f"({in_list('tag', REGION_TAGS)} AND {op} AND d_region = 1)"),
        ]),
        Sel(cols=[
            ("blk", f"sum(CASE WHEN boundary THEN 1 ELSE 0 END) {W}"),
            ("region_seq", f"sum(CASE WHEN region_start THEN 1 ELSE 0 END) {W}"),
        ]),
        # decoded text of text tokens outside <head>/<title>; raw inside pre, collapsed elsewhere
        Sel(cols=[("dec", f"CASE WHEN is_text AND NOT in_head THEN {X.decode_entities(d, 'tok')} END")]),
        Sel(cols=[("txt", f"CASE WHEN d_pre > 0 THEN dec ELSE {X.collapse_ws(d, 'dec')} END")]),
        Sel(cols=[("words", f"CASE WHEN txt IS NULL THEN CAST(0 AS BIGINT) ELSE {X.word_count(d, 'txt')} END")]),
    ]


def pages_source_duck(opts: Options = DEFAULT, source: str = "pages") -> str:
    return f"(SELECT page_id, url, html, {str(opts.include_links).upper()} AS lnk FROM {source})"


# --- query shapes: G1 / G3 / G10 ------------------------------------------------
def html_tokens_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """G1: one row per token with tag and direction."""
    return token_stages(d, opts) + [
        Sel(keep=["page_id", "pos", "tok", "tag"],
            cols=[("kind", "CASE WHEN o = 1 THEN 'open' WHEN c = 1 THEN 'close' WHEN is_text THEN 'text' ELSE 'decl' END")]),
    ]


def strip_chrome_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """Body tokens outside nav/header/footer/aside subtrees, with depth context."""
    return token_stages(d, opts) + nesting_stages(d, opts) + [
        Where(f"d_chrome = 0 AND NOT {in_list('tag', opts.chrome_tags)} AND NOT in_head"),
        Sel(keep=["page_id", "pos", "tok", "tag"], cols=[("depth", "CAST(d_lvl AS BIGINT)"), ("in_link", "d_a > 0")]),
    ]


def link_table_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """G10 + G8: every <a href> outside <head>: (page_id, pos, href, abs_href, text)."""
    return token_stages(d, opts) + nesting_stages(d, opts) + [
        Where("NOT in_head"),
        Sel(cols=[("link_pos", f"max(CASE WHEN tag = 'a' AND o = 1 THEN pos END) {W}")]),
        Where("(d_a > 0 OR (tag = 'a' AND o = 1)) AND cur_href IS NOT NULL"),
        Agg(["page_id", "link_pos"], [
            ("url", "min(url)"),
            ("href", "min_by(cur_href, pos)"),
            ("raw_text", d.listagg("coalesce(txt, '')", "pos")),
        ]),
        Sel(keep=["page_id"], cols=[
            ("pos", "CAST(link_pos AS BIGINT)"),
            ("href", "href"),
            ("abs_href", X.resolve_url(d, "url", "href")),
            ("text", X.js_trim(d, d.rx_replace("raw_text", " +", " "))),
        ]),
    ]


# Sentinels (never present in text: control characters are stripped from the HTML first).
B_O, B_C = "\x01", "\x02"      # strong
I_O, I_C = "\x03", "\x04"      # emphasis
S_O, S_C = "\x05", "\x06"      # strikethrough
BR = "\x07"                    # line break
K_O, K_C = "\x0e", "\x0f"      # inline code
A_O, A_M, A_E = "\x10", "\x11", "\x12"  # link open / link close + href / end of href


@dataclass(frozen=True)
class Rule:
    """K1: an inline rule; the tags map to (open, close) fragments."""
    name: str
    tags: tuple
    open: str
    close: str


# CommonMark + GFM conventions used for output.
#   headings "# " (ATX), bullet "-   ", ordered "N.  ", emphasis "_", strong "**",
#   strikethrough "~", code fence "```", horizontal rule "* * *", block quote "> ".
COMMONMARK = (
    Rule("strong", ("b", "strong"), B_O, B_C),
    Rule("emphasis", ("i", "em"), I_O, I_C),
    Rule("code", ("code",), K_O, K_C),
)
GFM = (Rule("strikethrough", ("del", "s", "strike"), S_O, S_C),)  # K2: the GFM plugin bundle
DEFAULT_RULES = COMMONMARK + GFM

BULLET = "-   "
HR = "* * *"
PAIRS = (  # sentinel pair -> delimiter, processed in this order
    (B_O, B_C, "**"),
    (I_O, I_C, "_"),
    (S_O, S_C, "~"),
)


def _rx(ch: str) -> str:
    return "\\x%02x" % ord(ch)


def _tags(tags) -> str:
    return "(" + ", ".join(f"'{t}'" for t in tags) + ")"


def changes_sql(rule: Rule) -> str:
    """+1 and -1 at the tags of a rule that count (outside <head> and pre), else 0."""
    return f"CASE WHEN tag IN {_tags(rule.tags)} AND d_pre = 0 AND NOT in_head THEN o - c ELSE 0 END"


def emits_sql(rule: Rule, kind: str) -> str:
    """Whether a tag opens (o) or closes (c) the outermost element of its rule in the block; ``e_*`` is
    the depth after the token, -1 at a stray close."""
    return f"(tag IN {_tags(rule.tags)} AND {kind} = 1 AND d_pre = 0 AND NOT in_head AND e_{rule.name} = {1 if kind == 'o' else 0})"


def fragment_sql(d: Dialect, opts: Options = DEFAULT, rules=DEFAULT_RULES) -> str:
    """Markdown fragment of one token (after the nesting stages)."""
    s = d.s
    link = (lambda u: u) if opts.compat else (lambda u: X.resolve_url(d, "url", u))
    href = d.rx_replace(link("cur_href"), "([()])", "\\\\$1")
    alt = d.rx_replace("coalesce(alt, '')", "\\s*\n+\\s*", "\n")
    parts = [
        "CASE WHEN in_head THEN ''",
        f"WHEN is_text THEN (CASE WHEN d_pre > 0 OR d_code > 0 THEN txt ELSE {X.md_escape(d, 'txt')} END)",
        f"WHEN d_pre > 0 AND tag = 'br' THEN {s(chr(10))}",
        "WHEN d_pre > 0 AND tag <> 'pre' THEN ''",
    ]
    for r in rules:
        parts.append(f"WHEN {emits_sql(r, 'o')} THEN {s(r.open)}")
        parts.append(f"WHEN {emits_sql(r, 'c')} THEN {s(r.close)}")
    parts.append(f"WHEN tag = 'br' THEN {s(BR)}")
    if True:  # per-page flag ``lnk`` (include_links)
        has = "lnk AND coalesce(cur_href, '') <> ''"
        parts.append(f"WHEN tag = 'a' AND o = 1 AND {has} THEN {s(A_O)}")
        parts.append(f"WHEN tag = 'a' AND c = 1 AND {has} THEN {s(A_M)} || {href} || {s(A_E)}")
    # H8: with include_links = false an anchor renders as its content only
    parts.append(f"WHEN tag = 'img' AND o = 1 THEN (CASE WHEN coalesce(src, '') <> '' THEN '![' || {alt} || '](' || {link('src')} || ')' ELSE '' END)")
    parts.append("WHEN tag = 'input' AND o = 1 AND itype = 'checkbox' THEN (CASE WHEN checked THEN '[x] ' ELSE '[ ] ' END)")
    parts.append("WHEN tag IN ('td', 'th') AND o = 1 THEN (CASE WHEN coalesce(cell_in_row, 1) <= 1 THEN '| ' ELSE ' | ' END)")
    parts.append(f"WHEN tag = 'hr' AND o = 1 THEN {s(HR)}")
    parts.append("ELSE '' END")
    return " ".join(parts)


def finish_inline(d: Dialect, frag: str, open_counts: dict) -> str:
    """Close formatting left open at the block end, pair sentinels into delimiters, move
    flanking spaces/breaks outside delimiters, drop strays, collapse spaces, apply breaks."""
    closers = " || ".join(f"repeat({d.s(c)}, CAST(greatest(0, {n}) AS INTEGER))" for c, n in open_counts.items())
    x = f"({frag} || {closers})"
    br = _rx(BR)
    for o_, c_, delim in PAIRS:
        ro, rc = _rx(o_), _rx(c_)
        x = d.rx_replace(x, f"{ro}([ {br}]*){rc}", "$1")
        x = d.rx_replace(x, f"{ro}([ {br}]*)([^{ro}{rc}]*?)([ {br}]*){rc}", f"$1{delim}$2{delim}$3")
    ko, kc = _rx(K_O), _rx(K_C)
    x = d.rx_replace(x, f"{ko}( *){kc}", "$1")
    x = d.rx_replace(x, f"{ko}([^{ko}{kc}]*`[^{ko}{kc}]*){kc}", "`` $1 ``")
    x = d.rx_replace(x, f"{ko}([^{ko}{kc}]*){kc}", "`$1`")
    ao, am, ae = _rx(A_O), _rx(A_M), _rx(A_E)
    x = d.rx_replace(x, f"{ao}([ {br}]*)([^{ao}{am}{ae}]*?)([ {br}]*){am}([^{ae}]*){ae}", "$1[$2]($4)$3")
    x = d.rx_replace(x, f"{am}[^{ae}]*{ae}", "")
    x = d.rx_replace(x, "[\\x01-\\x06\\x0e\\x0f\\x10]", "")
    x = d.rx_replace(x, " {2,}", " ")
    x = d.rx_replace(x, f" *{br} *", BR)
    x = d.rx_replace(x, "^ +| +$", "")
    x = d.rx_replace(x, f"^{br}+|{br}+$", "")
    return f"replace({x}, {d.s(BR)}, {d.s(chr(10))})"


def fenced(d: Dialect, code: str, lang: str) -> str:
    """H5: fenced code block; the fence is longer than any line-start backtick run of 3+."""
    body = d.rx_replace(d.rx_replace(code, "^\n", ""), "\n$", "")
    runs = d.rx_extract_all(body, "(?m)^`{3,}")
    size = f"greatest(3, coalesce({d.array_max(d.transform(runs, 'r', 'length(r) + 1'))}, 3))"
    fence = f"repeat('`', CAST({size} AS INTEGER))"
    return f"({fence} || coalesce({lang}, '') || {d.s(chr(10))} || {body} || {d.s(chr(10))} || {fence})"


def indent_lines(d: Dialect, x: str, n: str) -> str:
    """Every line after the first gets n more spaces."""
    return f"replace({x}, {d.s(chr(10))}, {d.s(chr(10))} || repeat(' ', CAST({n} AS INTEGER)))"


CONTAINER_TAGS = ("body", "div", "section")
BOILER_LD = "(1.0 / 3.0)"

W_BLK_RUN = run_w("page_id", "blk")
W_BLK_PREV = prev_w("page_id", "blk")
W_BLK_NEXT = prev_w("page_id", "blk DESC")
W_IN_RUN = run_w("page_id, blk", "pos")
W_IN_PREV = prev_w("page_id, blk", "pos")
W_LVL_RUN = run_w("page_id, lvl_key", "blk")
W_PAGE = all_w("page_id")


# --- D7 -------------------------------------------------------------------
def block_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """tokens -> one row per (page_id, blk): fragments, plain text, word and link features,
    and the context of the block's first token."""
    body_tok = (f"(NOT in_head AND NOT {in_list('tag', ('html', 'head', 'body'))} AND d_chrome = 0 "
                f"AND NOT {in_list('tag', opts.chrome_tags)})")
    markup = f"({body_tok} AND (tag <> '' OR (is_text AND {X.js_trim(d, 'tok')} <> '')))"
    lang = f"CASE WHEN tag = 'code' AND o = 1 AND d_pre > 0 THEN {d.rx_extract('cls', '(?:^|\\s)(?:language|lang)-(\\S+)', 1)} END"
    lvl_key = (f"CASE WHEN {in_list('tag', LEVEL_TAGS)} AND o = 1 THEN d_lvl "
               f"WHEN {in_list('tag', LEVEL_TAGS)} AND c = 1 THEN d_lvl + 1 WHEN tag = 'li' AND o = 1 THEN d_lvl END")
    first = lambda x: d.min_by(x, "pos")

    rules = {r.name: r for r in DEFAULT_RULES}

    def cnt(name, kind):
        return f"CAST(sum(CASE WHEN {emits_sql(rules[name], kind)} THEN 1 ELSE 0 END) AS BIGINT)"

    return [
        Sel(cols=[(f"f_{n}", f"sum({changes_sql(r)}) {W_IN_RUN}") for n, r in rules.items()]),
        # depth of each inline rule in its block, clamped at 0 before the token
        Sel(cols=[(f"e_{n}", f"f_{n} - least(0, coalesce(min(f_{n}) {W_IN_PREV}, 0))") for n in rules]),
        Sel(cols=[("frag", fragment_sql(d, opts)), ("markup", markup), ("lang", lang), ("lvl_key0", lvl_key)]),
        Agg(["page_id", "blk"], [
            ("url", "min(url)"),
            ("pos0", "min(pos)"),
            ("s_tag", first("tag")), ("s_o", first("o")), ("s_c", first("c")),
            ("s_start", first("start_attr")),
            ("lvl_key", first("lvl_key0")),
            ("d_chrome", first("d_chrome")), ("d_region", first("d_region")), ("region_seq", first("region_seq")),
            ("d_q", first("d_q")), ("d_list", first("d_list")), ("d_pre", first("d_pre")),
            ("d_table", first("d_table")), ("table_seq", first("table_seq")), ("row_in_table", first("row_in_table")),
            ("li_seq", first("li_seq")),
            ("h_level", first("CASE WHEN d_h > 0 THEN h_level ELSE 0 END")),
            ("frag", d.listagg("frag", "pos")),
            ("plain", d.listagg("txt", "pos")),
            ("words", "CAST(sum(words) AS BIGINT)"),
            ("link_words", "CAST(sum(CASE WHEN d_a > 0 THEN words ELSE 0 END) AS BIGINT)"),
            ("n_b_o", cnt("strong", "o")), ("n_b_c", cnt("strong", "c")),
            ("n_i_o", cnt("emphasis", "o")), ("n_i_c", cnt("emphasis", "c")),
            ("n_s_o", cnt("strikethrough", "o")), ("n_s_c", cnt("strikethrough", "c")),
            ("n_k_o", cnt("code", "o")), ("n_k_c", cnt("code", "c")),
            ("cells", "CAST(sum(CASE WHEN tag IN ('td', 'th') AND o = 1 THEN 1 ELSE 0 END) AS BIGINT)"),
            ("markup", "max(CASE WHEN markup THEN 1 ELSE 0 END)"),
            ("lang", d.min_by("lang", "CASE WHEN lang IS NOT NULL THEN pos END")),
        ]),
    ]


# --- E5 / E6 / classification -----------------------------------------------
def neighbour_stages(d: Dialect) -> list:
    """Link density, previous/next non-empty block features (E5), list ordinals (E6) and
    open-tag matching for containers, then the shallow-text boilerplate rule."""
    is_list_open = f"({in_list('s_tag', LIST_TAGS)} AND s_o = 1)"
    is_li = "(s_tag = 'li' AND s_o = 1)"
    in_levels = in_list("s_tag", LEVEL_TAGS)
    ol_start = f"CASE WHEN {d.rlike('s_start', '^-?[0-9]{1,9}$')} THEN CAST(s_start AS BIGINT) ELSE 1 END"
    content = (
        "CASE WHEN words = 0 THEN FALSE WHEN ld > (1.0 / 3.0) THEN FALSE "
        "WHEN prev_ld <= (5.0 / 9.0) THEN (words > 16 OR next_words > 15 OR prev_words > 4) "
        "ELSE (words > 40 OR next_words > 17) END"
    )
    return [
        Sel(cols=[("ld", "CASE WHEN words > 0 THEN CAST(link_words AS DOUBLE) / words ELSE 0.0 END")]),
        Sel(cols=[
            ("prev_words", f"coalesce({d.last_nn('CASE WHEN words > 0 THEN words END')} {W_BLK_PREV}, 0)"),
            ("prev_ld", f"coalesce({d.last_nn('CASE WHEN words > 0 THEN ld END')} {W_BLK_PREV}, 0.0)"),
            ("next_words", f"coalesce({d.last_nn('CASE WHEN words > 0 THEN words END')} {W_BLK_NEXT}, 0)"),
            ("li_run", f"sum(CASE WHEN {is_li} THEN 1 ELSE 0 END) {W_LVL_RUN}"),
            ("list_tag", f"{d.last_nn(f'CASE WHEN {is_list_open} THEN s_tag END')} {W_LVL_RUN}"),
            ("list_start", f"{d.last_nn(f'CASE WHEN {is_list_open} THEN {ol_start} END')} {W_LVL_RUN}"),
            ("match_open", f"{d.last_nn(f'CASE WHEN {in_levels} AND s_o = 1 THEN blk END')} {W_LVL_RUN}"),
        ]),
        Sel(cols=[("li_ord", f"li_run - {d.last_nn(f'CASE WHEN {is_list_open} THEN li_run END')} {W_LVL_RUN}")]),
        Sel(cols=[
            ("li_marker_here", f"CASE WHEN {is_li} THEN (CASE WHEN list_tag = 'ol' "
                               f"THEN CAST(list_start + li_ord - 1 AS VARCHAR) || '.  ' ELSE {d.s(BULLET)} END) END"),
            ("is_content", content),
        ]),
        Sel(cols=[("li_marker", f"{d.last_nn('li_marker_here')} {W_BLK_RUN}")]),
    ]


# --- D8 / F3 / G4 ---------------------------------------------------------
def choice_stages(d: Dialect) -> list:
    """Winning article region (rule 1) or section/div/body container (rule 2) per page, as
    window aggregates; container score = content words inside x (1 - link density inside),
    from prefix sums at the open and close blocks (no block x container join)."""
    ctag = in_list("s_tag", CONTAINER_TAGS)
    in_reg = "(d_region > 0 AND d_chrome = 0)"
    closed = "c_close_blk IS NOT NULL"
    cw_in = f"(CASE WHEN {closed} THEN cw1 ELSE cw_total END - cw_before)"
    w_in = f"(CASE WHEN {closed} THEN w1 ELSE w_total END - w_before)"
    lw_in = f"(CASE WHEN {closed} THEN lw1 ELSE lw_total END - lw_before)"
    score = f"({cw_in} * (1.0 - CASE WHEN {w_in} > 0 THEN CAST({lw_in} AS DOUBLE) / {w_in} ELSE 0.0 END))"
    cand = f"(c_is_open AND {cw_in} > 0)"
    w_cid = "OVER (PARTITION BY page_id, cid)"
    w_reg = "OVER (PARTITION BY page_id, region_seq)"
    return [
        Sel(cols=[
            ("cw", "CASE WHEN is_content AND d_chrome = 0 THEN words ELSE 0 END"),
            ("c_is_open", f"({ctag} AND s_o = 1)"),
            ("cid", f"CASE WHEN {ctag} AND s_o = 1 THEN blk WHEN {ctag} AND s_c = 1 THEN match_open END"),
            ("rw", f"sum(CASE WHEN {in_reg} THEN words ELSE 0 END) {w_reg}"),
        ]),
        Sel(cols=[
            ("cw_before", f"sum(cw) {W_BLK_RUN} - cw"),
            ("w_before", f"sum(words) {W_BLK_RUN} - words"),
            ("lw_before", f"sum(link_words) {W_BLK_RUN} - link_words"),
            ("cw_total", f"sum(cw) {W_PAGE}"),
            ("w_total", f"sum(words) {W_PAGE}"),
            ("lw_total", f"sum(link_words) {W_PAGE}"),
            # best region: max of (words, -seq) over candidate rows; one partition-only window
            ("rwin", f"max(CASE WHEN {in_reg} AND rw > 0 THEN {d.struct([('w', 'rw'), ('neg', '-region_seq'), ('r', 'region_seq')])} END) {W_PAGE}"),
        ]),
        Sel(cols=[
            ("c_close_blk", f"min(CASE WHEN cid IS NOT NULL AND NOT c_is_open THEN blk END) {w_cid}"),
            ("cw1", f"min(CASE WHEN cid IS NOT NULL AND NOT c_is_open THEN cw_before END) {w_cid}"),
            ("w1", f"min(CASE WHEN cid IS NOT NULL AND NOT c_is_open THEN w_before END) {w_cid}"),
            ("lw1", f"min(CASE WHEN cid IS NOT NULL AND NOT c_is_open THEN lw_before END) {w_cid}"),
        ]),
        Sel(cols=[("cand_score", f"CASE WHEN {cand} THEN {score} END")]),
        Sel(cols=[
            ("cwin", f"max(CASE WHEN cand_score IS NOT NULL THEN {d.struct([('s', 'cand_score'), ('neg', '-blk'), ('b', 'blk'), ('c', 'c_close_blk')])} END) {W_PAGE}"),
            ("any_markup", f"max(markup) {W_PAGE}"),
        ]),
        Sel(cols=[("win_region", "rwin.r"), ("c_open", "cwin.b"), ("c_close", "cwin.c")]),
        Sel(cols=[("source", "CASE WHEN win_region IS NOT NULL THEN 'article' "
                             "WHEN c_open IS NOT NULL THEN 'container' ELSE 'fallback' END")]),
        Sel(cols=[("keep", (
            f"CASE WHEN source = 'article' THEN (d_region > 0 AND region_seq = win_region AND d_chrome = 0 "
            f"AND (h_level > 0 OR ld <= {BOILER_LD})) "
            f"WHEN source = 'container' THEN (blk >= c_open AND (c_close IS NULL OR blk < c_close) AND d_chrome = 0 "
            f"AND (h_level > 0 OR ld <= {BOILER_LD})) "
            f"ELSE d_chrome = 0 END"))]),
    ]


# --- H1-H16 ---------------------------------------------------------------
def render_stages(d: Dialect) -> list:
    """Block Markdown for kept blocks and the separator before it; other rows get NULL."""
    counts = {B_C: "n_b_o - n_b_c", I_C: "n_i_o - n_i_c", S_C: "n_s_o - n_s_c", K_C: "n_k_o - n_k_c"}
    in_pre = "(d_pre > 0 OR (s_tag = 'pre' AND s_o = 1))"
    is_row = "((s_tag = 'tr' AND s_o = 1) OR (d_table > 0 AND cells > 0))"
    nl = d.s("\n")
    sep = "'| ' || array_to_string(list_transform(range(greatest(cells, 1)), lambda i: '---'), ' | ') || ' |'"
    row = f"({d.rx_replace('inline', chr(10), ' ')} || ' |')"
    row = f"CASE WHEN row_in_table = 1 THEN {row} || {nl} || {sep} ELSE {row} END"
    has = "md IS NOT NULL"
    prev = lambda x: f"{d.last_nn(f'CASE WHEN {has} THEN {x} END')} {W_BLK_PREV}"
    depth = "d_list"
    item = f"repeat(' ', CAST(({depth} - 1) * 4 AS INTEGER)) || li_marker || {indent_lines(d, 'md', f'{depth} * 4')}"
    cont = f"repeat(' ', CAST({depth} * 4 AS INTEGER)) || {indent_lines(d, 'md', f'{depth} * 4')}"
    qp = "repeat('> ', CAST(d_q AS INTEGER))"
    return [
        Sel(cols=[("inline", f"CASE WHEN keep THEN {finish_inline(d, 'frag', counts)} END"),
                  ("is_row", is_row), ("in_pre", in_pre)]),
        Sel(cols=[("body", (
            f"CASE WHEN NOT keep THEN NULL "
            f"WHEN in_pre THEN (CASE WHEN length(frag) > 0 THEN {fenced(d, 'frag', 'lang')} ELSE '' END) "
            f"WHEN is_row THEN (CASE WHEN cells > 0 THEN {row} ELSE '' END) ELSE inline END"))]),
        Sel(cols=[("md", "nullif(CASE WHEN h_level > 0 AND body <> '' "
                         "THEN repeat('#', h_level) || ' ' || body ELSE body END, '')")]),
        Sel(cols=[
            ("p_li", prev("li_seq")), ("p_blk", prev("blk")), ("p_row", prev("is_row")),
            ("p_table", prev("table_seq")), ("p_list", prev("d_list")), ("p_q", prev("d_q")),
        ]),
        Sel(cols=[("is_item", "(d_list > 0 AND li_marker IS NOT NULL AND li_seq <> coalesce(p_li, -1))")]),
        Sel(cols=[("md1", f"CASE WHEN is_item THEN {item} WHEN d_list > 0 THEN {cont} ELSE md END")]),
        Sel(cols=[
            ("md2", f"CASE WHEN {has} THEN (CASE WHEN d_q > 0 THEN {qp} || replace(md1, {nl}, {nl} || {qp}) "
                    f"ELSE md1 END) END"),
            ("lead", (
                f"CASE WHEN NOT ({has}) THEN NULL WHEN p_blk IS NULL THEN '' "
                f"WHEN is_row AND p_row AND p_table = table_seq THEN {nl} "
                f"WHEN is_item AND p_list > 0 THEN {nl} "
                f"WHEN d_q > 0 AND p_q > 0 THEN {nl} || rtrim(repeat('> ', CAST(least(d_q, p_q) AS INTEGER))) || {nl} "
                f"ELSE {d.s(chr(10) * 2)} END")),
        ]),
    ]


# --- D9 / H17 / G5-G7 -----------------------------------------------------
def assemble_stages(d: Dialect) -> list:
    """One row per page: tidy Markdown, first paragraph text, source and any_markup."""
    first_p = d.min_by("plain", "CASE WHEN keep AND s_tag = 'p' AND s_o = 1 AND words > 0 THEN blk END")
    return [
        Agg(["page_id"], [
            ("raw_md", d.listagg("lead || md2", "blk")),
            ("first_p", first_p),
            ("source", "max(source)"),
            ("any_markup", "max(any_markup)"),
        ]),
        Sel(keep=["page_id", "first_p", "source", "any_markup"],
            cols=[("markdown", X.tidy(d, "coalesce(raw_md, '')"))]),
    ]


def meta_stages(d: Dialect) -> list:
    """pages -> (page_id, url, doc_title, meta_excerpt, site_name) from <title> and <meta>."""
    def meta(key_re: str) -> str:
        hit = d.filter("metas", "m", d.rlike("m", f"(?i)[\\s\"'](name|property)\\s*=\\s*[\"']?({key_re})[\"'\\s/>]"))
        return f"nullif({X.js_trim(d, X.attr(d, d.elem(hit, 1), 'content'))}, '')"

    title = d.rx_extract("html", "(?is)<title\\b[^>]*+>(.*?)</title\\s*>", 1)
    head = d.rx_extract("html", "(?is)^(.*?)(?:<body\\b|$)", 1)
    return [
        Sel(keep=["page_id", "url"], cols=[
            ("title_raw", title),
            ("metas", d.rx_extract_all(d.rx_replace(head, "(?s)<!--.*?-->", ""), "(?i)<meta\\b[^>]*+>")),
        ]),
        Sel(keep=["page_id", "url"], cols=[
            ("doc_title", X.js_trim(d, X.collapse_ws(d, X.decode_entities(d, "title_raw")))),
            ("meta_excerpt", f"coalesce({meta('og:description')}, {meta('description')}, {meta('twitter:description')})"),
            ("site_name", meta("og:site_name")),
        ]),
    ]


def page_stages(d: Dialect, opts: Options = DEFAULT) -> list:
    """pages -> kept/rendered blocks -> page Markdown (everything but metadata)."""
    return (token_stages(d, opts) + nesting_stages(d, opts) + block_stages(d, opts) + neighbour_stages(d)
            + choice_stages(d) + render_stages(d) + assemble_stages(d))


# --- whole pages and query shapes -------------------------------------------
def result_cols(d: Dialect) -> list:
    """Final projection over meta LEFT JOIN page markdown."""
    blank = "(coalesce(source, 'fallback') = 'fallback' AND coalesce(any_markup, 0) = 0)"
    article = "(coalesce(source, 'fallback') <> 'fallback')"
    excerpt = f"coalesce(meta_excerpt, nullif({X.js_trim(d, d.rx_replace('first_p', ' +', ' '))}, ''))"
    return [
        ("title", f"CASE WHEN NOT {blank} THEN doc_title END"),
        ("excerpt", f"CASE WHEN NOT {blank} AND {article} THEN {excerpt} END"),
        ("site_name", f"CASE WHEN NOT {blank} AND {article} THEN site_name END"),
        ("word_count", f"CASE WHEN NOT {blank} THEN {X.word_count(d, 'coalesce(markdown, ' + chr(39) * 2 + ')')} END"),
        ("markdown", f"CASE WHEN NOT {blank} THEN coalesce(markdown, '') END"),
        ("source", "coalesce(source, 'fallback')"),
        ("error", f"CASE WHEN {blank} THEN {d.s(MSG_NO_CONTENT)} END"),
    ]


def clean_pages_duck(opts: Options = DEFAULT, source: str = "pages") -> str:
    """Whole pages as DuckDB SQL."""
    d = DUCK
    ctes1, last1 = duck_ctes(page_stages(d, opts), pages_source_duck(opts, source), "pg")
    ctes2, last2 = duck_ctes(meta_stages(d), source, "mt")
    cols = ", ".join(f"{sql} AS {a}" for a, sql in result_cols(d))
    return ("WITH " + ",\n".join(ctes1 + ctes2) +
            f"\nSELECT m.page_id, m.url, {cols} FROM {last2} m LEFT JOIN {last1} g ON m.page_id = g.page_id")


def _block_features(d):
    return token_stages(d) + nesting_stages(d) + block_stages(d) + [
        Sel(keep=["page_id", "blk", "s_tag", "words", "link_words", "plain"], cols=[])]


def _neighbours(d):
    return token_stages(d) + nesting_stages(d) + block_stages(d) + neighbour_stages(d) + [
        Sel(keep=["page_id", "blk"], cols=[
            ("words", "words"), ("prev_words", "CAST(prev_words AS BIGINT)"), ("next_words", "CAST(next_words AS BIGINT)"),
            ("is_content", "is_content"), ("li_marker", "li_marker_here")])]


def _choice(d):
    return token_stages(d) + nesting_stages(d) + block_stages(d) + neighbour_stages(d) + choice_stages(d)


def _containers(d):
    return _choice(d) + [Sel(keep=["page_id", "blk"], cols=[
        ("c_open", "CAST(c_open AS BIGINT)"), ("c_close", "CAST(c_close AS BIGINT)"),
        ("win_region", "CAST(win_region AS BIGINT)"), ("cand_score", "cand_score")])]


def _extract_article(d):
    return _choice(d) + [Agg(["page_id"], [
        ("source", "max(source)"),
        ("kept_blocks", "CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT)"),
        ("kept_words", "CAST(sum(CASE WHEN keep THEN words ELSE 0 END) AS BIGINT)"),
    ])]


def _content_or_fallback(d):
    return _choice(d) + [Agg(["page_id"], [
        ("source", "max(source)"),
        ("any_markup", "CAST(max(any_markup) AS BIGINT)"),
        ("content_text", d.listagg("CASE WHEN keep THEN plain END", "blk")),
    ])]


def _md_blocks(d):
    return _choice(d) + render_stages(d) + [
        Sel(keep=["page_id", "blk"], cols=[("lead", "lead"), ("md", "md2")]),
    ]


def _remove_elements(d):
    return [Sel(keep=["page_id"], cols=[("h", clean_html(d, "html"))])]


def _meta(d):
    return meta_stages(d)


def stages_sql(stage_fn, final_cols: str = "*", source: str = "pages") -> str:
    ctes, last = duck_ctes(stage_fn(DUCK), pages_source_duck(source=source), "s")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {final_cols} FROM {last}"
