"""Text/URL functions as SQL text for a dialect (Spark engine or DuckDB oracle).

Same semantics as ``pagemill.functions.text``; these are what the HTML pipeline stages use.
"""

from __future__ import annotations

from pagemill.functions.dialect import Dialect
from pagemill.functions.text import (
    COMMON_REFERENCES, LEGACY_RE, MD_ESCAPE_ANYWHERE, MD_ESCAPE_LEADING, MD_ESCAPE_ORDINAL, REF_PIECE_IN_ATTRIBUTE, REF_PIECE_IN_TEXT,
    REF_START, REF_VALUE, REFERENCES, WORD_BLANKS,
)
from pagemill.options import JS_BLANKS


def js_trim(d: Dialect, x: str) -> str:
    return d.trim(x, JS_BLANKS)


def word_count(d: Dialect, x: str) -> str:
    """Maximal non-whitespace runs, counted after every white space became a space."""
    y = f"translate({x}, {d.s(WORD_BLANKS)}, {d.s(' ' * len(WORD_BLANKS))})"
    return f"CAST(coalesce({d.rx_count(y, '[^ ]++')}, 0) AS BIGINT)"


def tidy(d: Dialect, x: str) -> str:
    x = d.rx_replace(x, "\n{3,}", "\n\n")
    x = d.rx_replace(x, "(?dm)[ \t]+$", "")
    return js_trim(d, x)


def collapse_ws(d: Dialect, x: str) -> str:
    return d.rx_replace(x, "[ \t\n\r\f]{2,}|[\t\n\r\f]", " ")  # a single space is no match


def _cp(d: Dialect, v: str) -> str:
    return d.cp2str(f"(CASE WHEN {v} <= 0 OR {v} > 1114111 OR {v} BETWEEN 55296 AND 57343 THEN 65533 ELSE {v} END)")


def _reference(d: Dialect, name: str) -> str:
    """Text of the reference ``name`` from the table, NULL where it has none."""
    table, key = d.s(REFERENCES), f"({d.s(REF_START)} || {name} || {d.s(REF_VALUE)})"
    rest = f"substring({table}, CAST(instr({table}, {key}) + length({key}) AS INTEGER))"
    return f"(CASE WHEN instr({table}, {key}) > 0 THEN {d.before(rest, REF_START)} END)"


def decode_entities(d: Dialect, x: str, attribute: bool = False) -> str:
    """All HTML 5 names, numbers of any length, and the names that need no semicolon; in an
    attribute those stay as they are before a letter, a digit or '=' (``?a=1&copy=2``)."""
    # in steps, so that no step repeats the one before it: (piece, digits), (piece, number), text
    pieces = REF_PIECE_IN_ATTRIBUTE if attribute else REF_PIECE_IN_TEXT
    digits = d.rx_extract("p", "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    first = d.transform(d.rx_extract_all(x, pieces), "p", d.struct([("p", "p"), ("d", digits)]))
    hexadecimal = f"({d.startswith('q.p', '&#x')} OR {d.startswith('q.p', '&#X')})"
    number = (f"CASE WHEN NOT {d.startswith('q.p', '&#')} THEN NULL WHEN q.d = '' THEN 0 WHEN length(q.d) > 7 THEN 1114112 "
              f"WHEN {hexadecimal} THEN {d.hex2int('q.d')} ELSE CAST(q.d AS BIGINT) END")
    second = d.transform(first, "q", d.struct([("p", "q.p"), ("n", number)]))
    windows = _reference(d, "'#' || CAST(r.n AS STRING)")
    legacy = f"^&({LEGACY_RE})"
    prefix = "r.p" if attribute else f"CASE WHEN {d.rlike('r.p', legacy)} THEN {_reference(d, d.rx_extract('r.p', legacy, 1))} || {d.rx_replace('r.p', legacy, '')} ELSE r.p END"
    common = "".join(f"WHEN r.p = '{name}' THEN {d.s(text)} " for name, text in COMMON_REFERENCES.items())  # without a search
    body = (
        f"CASE WHEN NOT {d.startswith('r.p', '&')} OR length(r.p) < 3 THEN r.p " + common +
        f"WHEN r.n IS NOT NULL THEN coalesce(CASE WHEN r.n BETWEEN 128 AND 159 THEN {windows} END, {_cp(d, 'r.n')}) "
        + (f"WHEN {d.rlike('r.p', legacy + '[=A-Za-z0-9]$')} THEN r.p " if attribute else "")
        + f"ELSE coalesce({_reference(d, d.rx_replace('r.p', '^&|;$', ''))}, {prefix}) END"
    )
    decoded = d.array_join(d.transform(second, "r", body), "")
    if x.isidentifier():  # cheap guard: only strings holding '&' go through the lambda
        return f"(CASE WHEN instr({x}, '&') > 0 THEN {decoded} ELSE {x} END)"
    return decoded


def md_escape(d: Dialect, x: str) -> str:
    """Escapes of a text; those that stand for its beginning are looked for only where its first character can begin one."""
    led = d.rx_replace(d.rx_replace(md_escape_inside(d, x), MD_ESCAPE_LEADING, "\\\\$1"), MD_ESCAPE_ORDINAL, "$1\\\\. ")
    return f"(CASE WHEN instr('-+=#~>0123456789', substring({x}, 1, 1)) > 0 THEN {led} ELSE {md_escape_inside(d, x)} END)"


def md_escape_inside(d: Dialect, x: str) -> str:
    """The escapes that don't depend on the place in the line."""
    return d.rx_replace(x, MD_ESCAPE_ANYWHERE, "\\\\$1")


def raw_attr(d: Dialect, tok: str, name: str) -> str:
    """Attribute value of a start-tag token as written ('' when absent)."""
    v = d.rx_extract(tok, f"(?i)[\\s\"'/]{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1)
    return d.rx_replace(v, "^\"(.*)\"$|^'(.*)'$", "$1$2")


def attr(d: Dialect, tok: str, name: str) -> str:
    """Attribute value of a start-tag token ('' when absent), entities decoded."""
    return decode_entities(d, raw_attr(d, tok, name), attribute=True)


def has_attr(d: Dialect, tok: str, name: str) -> str:
    return d.rlike(tok, f"(?i)[\\s\"'/]{name}(\\s*=|[\\s/>])")


# --- G8 ---------------------------------------------------------------------
PATH_SAFE_CLASS = "!$-;=@-_a-z|~"      # printable ASCII except space " # < > ? ` { }
QUERY_SAFE_CLASS = "!$-&(-;=?-~"       # printable ASCII except space " # < > '
FRAGMENT_SAFE_CLASS = "!#-;=?-_a-~"    # printable ASCII except space " < > `


def pct_encode(d: Dialect, x: str, safe: str = PATH_SAFE_CLASS) -> str:
    """UTF-8 percent-encode characters outside ``safe`` (a regex class body)."""
    body = f"CASE WHEN {d.rlike('ch', '^[' + safe + ']$')} THEN ch ELSE {d.rx_replace(d.utf8_hex('ch'), '(..)', '%$1')} END"
    enc = d.array_join(d.transform(d.rx_extract_all(x, "(?s)."), "ch", body), "")
    return f"(CASE WHEN {d.rlike(x, '[^' + safe + ']')} THEN {enc} ELSE {x} END)"


def pct_encode_path(d: Dialect, x: str) -> str:
    return pct_encode(d, x, PATH_SAFE_CLASS)


def remove_dots(d: Dialect, x: str) -> str:
    """'.' and '..' segments (also as %2e) of a path from its '/', folded from left to right."""
    path = d.rx_replace(x, "(?i)(/(?:\\.|%2e){1,2})$", "$1/")  # a dot segment at the end leaves a '/'
    step = (
        "CASE WHEN lower(sg) IN ('.', '%2e') THEN acc "
        f"WHEN lower(sg) IN ('..', '.%2e', '%2e.', '%2e%2e') THEN {d.rx_replace('acc', '/[^/]*$', '')} "
        "ELSE acc || '/' || sg END"
    )
    return d.fold_text(d.split(f"substring({path}, 2)", "/"), "acc", "sg", step)


def resolve_url(d: Dialect, base: str, ref: str) -> str:
    """Resolve ``ref`` (already trimmed) against absolute ``base`` (absolute, //, /, ?, #, relative)."""
    origin = d.rx_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)", 1)
    scheme = d.rx_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1)
    bpath = d.rx_extract(base, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)", 1)
    bdir = d.rx_replace(f"(CASE WHEN {bpath} = '' THEN '/' ELSE {bpath} END)", "[^/]*$", "")
    no_frag = d.rx_replace(base, "#.*$", "")
    no_query = d.rx_replace(no_frag, "\\?.*$", "")
    rp = d.rx_extract(ref, "^([^?#]*)", 1)
    rtail = d.rx_extract(ref, "^[^?#]*(.*)$", 1)
    abs_path = f"({remove_dots(d, pct_encode_path(d, rp))} || {rtail})"
    rel_path = f"({remove_dots(d, pct_encode_path(d, f'({bdir} || {rp})'))} || {rtail})"
    return (
        f"(CASE WHEN {ref} IS NULL THEN NULL "
        f"WHEN {d.rlike(ref, '^[A-Za-z][A-Za-z0-9+.\\-]*:')} THEN {ref} "
        f"WHEN {d.startswith(ref, '//')} THEN {scheme} || {ref} "
        f"WHEN {ref} = '' THEN {no_frag} "
        f"WHEN {d.startswith(ref, '#')} THEN {no_frag} || {ref} "
        f"WHEN {d.startswith(ref, '?')} THEN {no_query} || {ref} "
        f"WHEN {d.startswith(ref, '/')} THEN {origin} || {abs_path} "
        f"ELSE {origin} || {rel_path} END)"
    )
