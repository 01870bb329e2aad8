"""Run options and the fixed values the engine must share with the behaviour it rebuilds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written; they define observable output)
# ---------------------------------------------------------------------------

DEFAULT_TIMEOUT_MS = 20_000
DEFAULT_MAX_BYTES = 5 * 1024 * 1024
DEFAULT_RENDER_TIMEOUT_MS = 30_000
MAX_REDIRECTS = 5

EVENT_PAGE_SCRAPED = "page-scraped"
EVENT_PAGE_RENDERED = "page-rendered"

# Elements dropped with their whole content before conversion.
REMOVED_TAGS = ("script", "style", "noscript", "iframe", "form")
# Page chrome removed from the fallback body (and from any article region).
CHROME_TAGS = ("nav", "header", "footer", "aside")

# Error messages, verbatim. "{}" marks interpolated values.
MSG_INVALID_URL = '"{}" is not a valid URL. Make sure it starts with http:// or https://'
MSG_BAD_SCHEME = 'Only http and https URLs are supported (got "{}").'
MSG_PRIVATE_LITERAL = "Refusing to fetch a private or internal address ({})."
MSG_UNRESOLVED = 'Could not resolve the host "{}".'
MSG_NO_ADDRESS = 'The host "{}" did not resolve to any address.'
MSG_PRIVATE_RESOLVED = 'Refusing to fetch "{}" because it resolves to a private or internal address ({}).'
MSG_TOO_LARGE = "The page is larger than the {}-byte limit and was not downloaded."
MSG_TIMEOUT = "The page took longer than {} ms to respond and was aborted."
MSG_REDIRECT_NO_LOCATION = "The server returned a redirect (HTTP {}) without a destination."
MSG_TOO_MANY_REDIRECTS = "The page redirected too many times (more than {})."
MSG_HTTP_STATUS = "The server returned HTTP {} ({}) for {}."
MSG_NOT_HTML = 'That URL is not an HTML page (content-type: "{}"). This tool only reads web pages.'
MSG_NO_CONTENT = "The page loaded but contained no readable text content to extract."
MSG_NO_URLS = 'No URLs given. Provide "url" (a single page) or "startUrls" (a list of pages).'
MSG_UNEXPECTED_PREFIX = "Unexpected error: "
STATUS_DONE = "Done. Scraped {} page(s), {} failed"
STATUS_BUDGET_SUFFIX = " (stopped at charge limit)."

# JavaScript's \s and String.prototype.trim() whitespace set, as code points.
JS_WS_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)


JS_BLANKS = "".join(map(chr, JS_WS_CODEPOINTS))


def _java_class(cps) -> str:
    return "".join(f"\\x{{{cp:04x}}}" for cp in cps)


# Java (Spark) and RE2 (DuckDB) both accept the \x{hhhh} spelling.
JS_WS = "[" + _java_class(JS_WS_CODEPOINTS) + "]"
JS_NON_WS = "[^" + _java_class(JS_WS_CODEPOINTS) + "]"


@dataclass(frozen=True)
class Rule:
    """K1: how elements of the given tags render: between ``open`` and ``close`` (both empty: as their content),
    or, with ``remove``, not at all. A rule without tags switches a block form on: ``table`` or ``task``."""
    name: str
    tags: tuple = ()
    open: str = ""
    close: str = ""
    remove: bool = False


# CommonMark + GFM conventions used for output.
#   headings "# " (ATX), bullet "-   ", ordered "N.  ", emphasis "_", strong "**",
#   strikethrough "~", code fence "```", horizontal rule "* * *", block quote "> ".
COMMONMARK = (
    Rule("strong", ("b", "strong"), "**", "**"),
    Rule("emphasis", ("i", "em"), "_", "_"),
    Rule("code", ("code",), "`", "`"),
)
GFM = (Rule("strikethrough", ("del", "s", "strike"), "~", "~"), Rule("table"), Rule("task"))  # K2: the GFM bundle
#: Letters that stand for rules in the arrays of a page.
RULE_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Options:
    """Per-run options; every field maps to a literal in the plan (constant-folded by Catalyst)."""

    timeout_ms: int = DEFAULT_TIMEOUT_MS
    max_bytes: int = DEFAULT_MAX_BYTES
    include_links: bool = True
    render_js: bool = False
    render_wait_ms: int = 0
    removed_tags: tuple = REMOVED_TAGS
    chrome_tags: tuple = CHROME_TAGS
    # Resolve relative links/images against the page URL (the reference only does this on
    # the article path; compat=True keeps raw hrefs on the fallback path).
    compat: bool = False
    # Number of hash partitions for the page -> token stage; None = spark.sql.shuffle.partitions.
    page_partitions: int | None = None
    # K1/K2: rendering rules; where two name a tag, the later one holds.
    rules: tuple = COMMONMARK + GFM
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.rules) > len(RULE_LETTERS):
            raise ValueError(f"at most {len(RULE_LETTERS)} rules")

    def letters(self) -> dict[str, str]:
        """The letter of each formatting tag's rule."""
        out = {}
        for letter, rule in zip(RULE_LETTERS, self.rules, strict=False):
            for tag in rule.tags:
                out[tag] = letter if rule.open or rule.close else ""
        return {tag: letter for tag, letter in out.items() if letter}

    def delimiters(self) -> dict[str, tuple[str, str]]:
        """Opening and closing delimiter by letter."""
        return {letter: (rule.open, rule.close) for letter, rule in zip(RULE_LETTERS, self.rules, strict=False) if rule.open or rule.close}

    def has(self, name: str) -> bool:
        return any(r.name == name and not r.tags for r in self.rules)

    def with_(self, **kw) -> "Options":
        return replace(self, **kw)


DEFAULT = Options()
