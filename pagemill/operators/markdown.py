"""Tokens -> Markdown fragments.

Formatting is typed: each text, image and checkbox carries the rules that open before and close
after it (letters of ``Options.delimiters``), given by the tree, so no text can pass for formatting.
Links and separators inside table cells are further letters. A block's Markdown is its fragments
joined; block-level structure becomes a per-block prefix.
"""

from __future__ import annotations

from pagemill.functions import sqltext as X
from pagemill.functions.dialect import SPARK as D
from pagemill.operators import tree as T
from pagemill.options import Options

BULLET = "-   "
HR = "* * *"


def delimiters(letters: str, opts: Options, closing: bool, href: str = "''") -> str:
    """The delimiters of a row of letters, each opening or closing; links only where the page has them."""
    cases = [f"WHEN '{letter}' THEN {D.s(pair[closing])}" for letter, pair in opts.delimiters().items()]
    cases.append(f"WHEN '{T.LINK}' THEN (CASE WHEN NOT lnk THEN '' " + (f"ELSE concat('](', {href}, ')') END)" if closing else "ELSE '[' END)"))
    cases += [f"WHEN '{T.ROW_BREAK}' THEN '<br>'", f"WHEN '{T.CELL_BREAK}' THEN ' \\\\| '"]
    return f"(CASE WHEN {letters} = '' THEN '' ELSE array_join(transform(split({letters}, ''), l -> CASE l {' '.join(cases)} ELSE '' END), '') END)"


def fragments_sql(opts: Options) -> str:
    """One fragment per token, from ``tokens``, ``txts``, ``toks`` and ``links``."""
    txt, tok = "txts[i]", "toks[i]"
    core = f"btrim({txt}, ' ')"
    lead, trail = f"(CASE WHEN startswith({txt}, ' ') THEN ' ' ELSE '' END)", f"(CASE WHEN endswith({txt}, ' ') THEN ' ' ELSE '' END)"
    # line-start escapes apply where the text begins the line or its token does
    escaped = f"(CASE WHEN (c.f & {T.LINE_START}) > 0 OR {lead} = '' THEN {X.md_escape(D, core)} ELSE {X.md_escape_inside(D, core)} END)"
    href = D.rx_replace("links[c.ref]", "([()])", "\\\\$1")
    alt = D.rx_replace(X.attr(D, tok, "alt"), "\\s*\n+\\s*", "\n")
    image = f"concat('![', {alt}, '](', links[c.ref], ')')"
    checkbox = f"(CASE WHEN {X.has_attr(D, tok, 'checked')} THEN '[x] ' ELSE '[ ] ' END)"
    opening, closing = delimiters("c.pre", opts, False), delimiters("c.post", opts, True, href)
    cell = ("'| '", "' | '") if opts.has("table") else ("' '", "' '")
    around = lambda x: f"concat({opening}, {x}, {closing})"
    return (
        f"transform(tokens, (c, i) -> CASE c.k WHEN {T.NOTHING} THEN '' "
        f"WHEN {T.TEXT} THEN (CASE WHEN {txt} = ' ' THEN ' ' WHEN c.pre = '' AND c.post = '' THEN concat({lead}, {escaped}, {trail}) ELSE concat({lead}, {around(escaped)}, {trail}) END) "
        f"WHEN {T.RAW} THEN {txt} WHEN {T.CODE_TEXT} THEN concat({lead}, {around(core)}, {trail}) WHEN {T.BREAK} THEN {D.s(chr(10))} "
        f"WHEN {T.IMAGE} THEN {around(image)} WHEN {T.CHECKBOX} THEN {around(checkbox)} WHEN {T.RULE} THEN {D.s(HR)} "
        f"WHEN {T.FIRST_CELL} THEN {cell[0]} WHEN {T.CELL} THEN {cell[1]} ELSE '' END)"
    )


def finish_inline(x: str) -> str:
    """Collapse runs of spaces, drop them around breaks and trim the block."""
    x = D.rx_replace(x, " {2,}", " ")
    x = D.rx_replace(x, " *\n *", "\n")
    return f"btrim({x}, {D.s(chr(10) + ' ')})"


def fenced(code: str, lang: str) -> str:
    """H5: fenced code block; the fence is longer than any line-start backtick run of 3+."""
    body = D.rx_replace(D.rx_replace(code, "^\n", ""), "\n$", "")
    size = f"greatest(3, coalesce(array_max(transform({D.rx_extract_all(body, '(?m)^`{3,}')}, r -> length(r) + 1)), 3))"
    fence = f"repeat('`', CAST({size} AS INTEGER))"
    return f"concat({fence}, {lang}, {D.s(chr(10))}, {body}, {D.s(chr(10))}, {fence})"


def indent_lines(x: str, n: str) -> str:
    """Every line after the first gets n more spaces."""
    return f"replace({x}, {D.s(chr(10))}, concat({D.s(chr(10))}, repeat(' ', CAST({n} AS INTEGER))))"
