"""Column-level text functions (all JVM-side built-ins; no Python UDFs).

Each function takes and returns a ``Column`` so Catalyst can fold, push and
code-generate it inside the surrounding stage.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.options import JS_BLANKS, JS_WS_CODEPOINTS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- I1 -------------------------------------------------------------------
def js_trim(col) -> Column:
    """JavaScript ``String.prototype.trim``: strips Unicode white space and BOM, not only spaces."""
    return F.btrim(_c(col), F.lit(JS_BLANKS))


# --- D1 -------------------------------------------------------------------
WORD_BLANKS = "".join(chr(c) for c in JS_WS_CODEPOINTS if c != 0x20)


def word_count(col) -> Column:
    """Number of maximal runs of characters that aren't white space (0 for NULL)."""
    c = F.translate(_c(col), WORD_BLANKS, " " * len(WORD_BLANKS))
    return F.coalesce(F.regexp_count(c, F.lit("[^ ]++")), F.lit(0)).cast("bigint")


# --- H17 ------------------------------------------------------------------
def tidy_markdown(col) -> Column:
    """Collapse 3+ newlines to 2, THEN strip trailing blanks per line, then trim (order matters)."""
    c = F.regexp_replace(_c(col), "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "(?dm)[ \t]+$", "")
    return js_trim(c)


# --- H16 ------------------------------------------------------------------
def collapse_ws(col) -> Column:
    """HTML inline whitespace collapsing (outside ``pre``)."""
    return F.regexp_replace(_c(col), "[ \t\n\r\f]+", " ")


# --- G9 -------------------------------------------------------------------
# Character references come from the Python standard library: all HTML 5 names, those among them
# that need no semicolon, and for the numbers 128-159 the Windows-1252 characters, as in HTML.
def _references() -> dict[str, str]:
    table = {name: html5[name + ";"] for name in ("amp", "lt", "gt", "quot", "nbsp", "apos")}  # found first
    for n in range(128, 160):
        char = bytes([n]).decode("cp1252", "ignore")
        if char:
            table[f"#{n}"] = char
    return table | {name.rstrip(";"): value for name, value in sorted(html5.items())}


COMMON_REFERENCES = {f"&{name};": html5[name + ";"] for name in ("amp", "lt", "gt", "quot", "nbsp", "apos", "middot", "copy", "mdash", "ndash", "hellip")}
REF_START, REF_VALUE = "\x01", "\x02"
#: One literal, START name VALUE text for each reference: cheap to parse, searched with instr.
REFERENCES = "".join(f"{REF_START}{name}{REF_VALUE}{value}" for name, value in _references().items()) + REF_START
LEGACY_RE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_REF = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|"
REF_PIECE_IN_TEXT = f"{_REF}(?:{LEGACY_RE}))|[^&]+|&"
REF_PIECE_IN_ATTRIBUTE = f"{_REF}(?:{LEGACY_RE})[=A-Za-z0-9]|(?:{LEGACY_RE}))|[^&]+|&"


# --- H15 ------------------------------------------------------------------
# Markdown escaping applied to every text node outside code, in this order.
#   \ -> \\     * -> \*     leading - -> \-     leading "+ " -> "\+ "   leading =+ -> \=+
#   leading "#{1,6} " -> "\# "    ` -> \`    leading ~~~ -> \~~~    [ -> \[    ] -> \]
#   leading > -> \>     _ -> \_     leading "N. " -> "N\. "
MD_ESCAPE_ANYWHERE = "([\\\\*`\\[\\]_])"
MD_ESCAPE_LEADING = "^(-|\\+ |=+|#{1,6} |~~~|>)"
MD_ESCAPE_ORDINAL = "^([0-9]+)\\. "


def md_escape(col) -> Column:
    c = F.regexp_replace(_c(col), MD_ESCAPE_ANYWHERE, "\\\\$1")
    c = F.regexp_replace(c, MD_ESCAPE_LEADING, "\\\\$1")
    return F.regexp_replace(c, MD_ESCAPE_ORDINAL, "$1\\\\. ")
