"""Main text of pages by wrappers: union-free regular expressions inferred for each host's templates.

A page is a tree of block elements over text. Pages of a host whose containers of text lie at the
same paths (its signature) are aligned, all of them, into a wrapper: adjacent siblings of one kind
fold into a repeated group, siblings that only some pages have become optional, and texts that differ
become slots. The wrapper's region of the main text is the article (or main) element, else the
element whose slots hold most text for their links; parts that pages mark as menus, notices, adverts,
comments and the like are no part of it.

Every page goes through its wrapper: a first pass reads it into its expression and its blocks of text
with their paths, and the blocks at the paths of the wrapper's region are the main text. A signature's pages
have the articles that hold text at the same paths; where there are none, the page's own region counts
too, without its template's fixed texts.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_path, small_batches

#: Wrappers up to this many are broadcast (about 1 KB each); more are joined by shuffle.
BROADCAST_HOSTS = 20_000

# Elements of HTML by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside form script style noscript template button select option textarea input iframe object embed svg canvas video audio map dialog menu head title fieldset".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Block elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CONTAINERS = frozenset("html body div section td tr tbody table center".split())
SCOPE = frozenset("table td th ul ol dl div article section main aside nav header footer form body blockquote".split())
CHROME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|menu|nav\w*|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|respon[ds]\w*|replies|reply|discussion|disqus|footer|header|masthead|toolbar|pagination|pager|tags?|copyright|skip|search)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z](?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*\Z", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Element:
    __slots__ = ("tag", "sort", "dropped", "children")

    def __init__(self, tag: str, sort: str = "", dropped: bool = False):
        self.tag, self.sort, self.dropped, self.children = tag, sort, dropped, []


def is_dropped(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROPPED or attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return True
    return tag not in ("body", "html", "article", "main") and any(CHROME.search(attrs.get(k, "")) for k in ("class", "id")) or tag in ("article", "main") and bool(re.search(r"comment|reply|teaser|related|ad-", attrs.get("class", "") + attrs.get("id", "")))


def parse(page: str) -> Element:
    """The tree of elements and texts (str); closing tags that are missing are implied."""
    root = Element("html")
    stack, at, n = [root], 0, len(page)
    while at <= n:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if not m:
            break
        at = max(m.end(), at + 1)
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE and stack[k].tag != "p":
                    break
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if tag in ENDS_P and any(e.tag == "p" for e in stack):
            k = max(i for i, e in enumerate(stack) if e.tag == "p")
            if not any(e.tag in SCOPE for e in stack[k + 1 :]):
                del stack[k:]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k].tag in SCOPE:
                break
        if tag == "body" and any(e.tag == "head" for e in stack):
            del stack[next(i for i, e in enumerate(stack) if e.tag == "head") :]
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m["attrs"] or "")}
        if re.search(r"(?:^|\s)hidden(?:\s|$)", ATTR.sub(" ", m["attrs"] or "")):
            attrs["hidden"] = ""
        sort = " ".join(sorted(set(attrs.get("class", "").lower().split()))) or re.sub(r"\d+", "#", attrs.get("id", ""))
        e = Element(tag, sort, is_dropped(tag, attrs))
        stack[-1].children.append(e)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n + 1
        elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            stack.append(e)
    return root


# --- wrappers: [kind, occurs, dropped, children]; kind is "tag.class" or "#text"; a text's children are
# its fixed words or None for a slot, and its size; occurs is "1", "?", "+" or "*".


def kind_of(e: Element) -> str:
    return f"{e.tag}.{e.sort}" if e.sort else e.tag


def expression(e: Element) -> list:
    """The regular expression of one page: repeated siblings folded, texts as they are."""
    parts = []
    for c in e.children:
        if isinstance(c, str):
            words = " ".join(c.split())
            if words:
                parts.append(["#text", "1", False, [words, len(words)]])
        elif c.tag in INLINE and not c.dropped:
            inner = expression(c)[3]
            size = sum(p[3][1] if p[0] == "#text" else 0 for p in inner)
            parts += [["#text", "1", False, [None if c.tag != "a" else "", 0 if c.tag == "a" else size]]] if inner and all(p[0] == "#text" for p in inner) else inner
        elif c.dropped:
            parts.append(["!" + kind_of(c), "1", True, []])  # never one kind with a part that stays
        else:
            parts.append(expression(c))
    return [kind_of(e), "1", e.dropped, fold(parts)]


def merged(a: list, b: list, occurs: str) -> list:
    """One expression for two of a kind."""
    if a[0] == "#text":
        same = a[3][0] == b[3][0] and a[3][0] is not None
        return ["#text", occurs, False, [a[3][0] if same else None, a[3][1] + (0 if same else b[3][1])]]
    return [a[0], occurs, a[2] or b[2], align(a[3], b[3])]


def fold(parts: list[list]) -> list[list]:
    """Adjacent parts of one kind, and adjacent pairs of kinds, as repeated groups."""
    out: list[list] = []
    for p in parts:
        if out and out[-1][0] == p[0]:
            out[-1] = merged(out[-1], p, "+")
        elif len(out) >= 2 and out[-2][0] == p[0] and out[-1][0] != "#text" and p[0] != "#text" and out[-1][1] in "1?*+":
            out[-2] = merged(out[-2], p, "+")  # the pair (x y) begins again; y joins its own group next
            out[-1] = [out[-1][0], "*", *out[-1][2:]]
        else:
            out.append(p)
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """Least common expression of two sequences: what only one of them has becomes optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else 0)
    out, i, j = [], 0, 0
    loose = lambda p: [p[0], "*" if p[1] in "+*" else "?", *p[2:]]
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            both = {a[i][1], b[j][1]}
            occurs = "*" if "*" in both or both >= {"?", "+"} else "+" if "+" in both else "?" if "?" in both else "1"
            out.append(merged(a[i], b[j], occurs))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(loose(a[i]))
            i += 1
        else:
            out.append(loose(b[j]))
            j += 1
    return out


def infer(pages: list[str]) -> list:
    """The wrapper of some pages of one host."""
    wrapper = None
    for page in pages:
        one = expression(parse(page))
        wrapper = one if wrapper is None else merged(wrapper, one, "1")
    return wrapper


def slots_size(node: list) -> int:
    """Text of an element's slots, without dropped parts."""
    if node[0] == "#text":
        return node[3][1] if node[3][0] is None or len(node[3][0]) > 0 else 0
    return 0 if node[2] else sum(slots_size(c) for c in node[3])


def region(wrapper: list) -> list[list[str]]:
    """Paths of the main text's elements: articles, else main, else the element with most slot text
    that no single child of it holds nearly all of."""
    found: dict[str, list[list[str]]] = {"article": [], "main": []}

    def walk(node, path):
        if node[0] == "#text" or node[2]:
            return
        path = [*path, node[0]]
        tag = node[0].split(".")[0]
        if tag in found and slots_size(node):
            found[tag].append(path)
            if tag == "article":
                return
        for c in node[3]:
            walk(c, path)

    walk(wrapper, [])
    for tag in ("article", "main"):
        if found[tag]:
            return found[tag]
    node, path = wrapper, [wrapper[0]]
    while True:
        inner = [c for c in node[3] if c[0] != "#text" and not c[2] and c[0].split(".")[0] in CONTAINERS]
        top = max(inner, key=slots_size, default=None)
        if top is None or slots_size(top) < 0.75 * slots_size(node) or not slots_size(top):
            return [path] if slots_size(node) else []
        node, path = top, [*path, top[0]]


def blocks(e: Element, out: list[str], held: list[str]) -> None:
    """Texts of an element's blocks, in page order; inline elements belong to the block around them."""
    for c in e.children:
        if isinstance(c, str):
            held.append(c)
        elif c.dropped:
            held.append(" ") if c.tag in INLINE else flush(out, held)
        elif c.tag == "br":
            held.append(" ")
        elif c.tag in INLINE:
            blocks(c, out, held)
        else:
            flush(out, held)
            blocks(c, out, held)
            flush(out, held)


def flush(out: list[str], held: list[str]) -> None:
    text = " ".join("".join(held).split())
    held.clear()
    if text:
        out.append(text)


def by_articles(paths: list[list[str]]) -> bool:
    return bool(paths) and paths[0][-1].split(".")[0] in ("article", "main")


def articles_of_links(node: list, path: tuple = ()) -> list[list[str]]:
    """Paths of articles and main elements that hold text, be it in links only."""
    if node[0] == "#text" or node[2]:
        return []
    path = (*path, node[0])
    if node[0].split(".")[0] in ("article", "main") and has_text(node):
        return [list(path)]
    return [p for c in node[3] for p in articles_of_links(c, path)]


def has_text(node: list) -> bool:
    return node[0] == "#text" or not node[2] and any(map(has_text, node[3]))


def signature(wrapper: list) -> str:
    """A digest of the paths of the containers, articles and main elements that hold text (of articles the outermost)."""
    found = set()

    def walk(node, path):
        if node[0] == "#text" or node[2]:
            return
        path = (*path, node[0])
        tag = node[0].split(".")[0]
        if (tag in CONTAINERS or tag in ("article", "main")) and slots_size(node):
            found.add(path)
            if tag == "article":
                return
        for c in node[3]:
            walk(c, path)

    walk(wrapper, ())
    return hashlib.blake2b(json.dumps(sorted(found)).encode(), digest_size=16).hexdigest()


def digest(words: str) -> str:
    return words if len(words) <= 16 else hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def short(node: list) -> list:
    """The expression with digests for long texts."""
    if node[0] == "#text":
        words = node[3][0]
        return [*node[:3], [words and digest(words), node[3][1]]]
    return [*node[:3], [short(c) for c in node[3]]]


def fixed_texts(node: list) -> set[str]:
    """Digests of a wrapper's texts that are no slots."""
    if node[0] == "#text":
        return {node[3][0]} if node[3][0] else set()
    return set() if node[2] else {t for c in node[3] for t in fixed_texts(c)}


def without(node: list, fixed: set[str]) -> list:
    """A shortened expression in which fixed texts have no size."""
    if node[0] == "#text":
        return [*node[:3], ["", 0]] if node[3][0] in fixed else node
    return [*node[:3], [without(c, fixed) for c in node[3]]]


def apply(page: str | Element, paths: list[list[str]]) -> str | None:
    """The main text by the wrapper's region; None if the page has no element at its paths."""
    found, out = [], []

    def walk(e, depth, live):
        if e.dropped:
            return
        kind = kind_of(e)
        live = [p for p in live if depth < len(p) and p[depth] == kind]
        if any(len(p) == depth + 1 for p in live):
            found.append(e)
            held: list[str] = []
            blocks(e, out, held)
            flush(out, held)
        elif live:
            for c in e.children:
                if isinstance(c, Element):
                    walk(c, depth + 1, live)

    walk(parse(page) if isinstance(page, str) else page, 0, paths)
    return "\n\n".join(out) if found else None


def extract(page: str | None, paths: list[list[str]] | None) -> str:
    """The main text of a page, by its host's region or else by that of the page alone."""
    if not page:
        return ""
    return paths and apply(page, paths) or apply(page, region(infer([page]))) or ""


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def place(path: list[str]) -> str:
    """A path as text; a path's text begins with those of the elements around it."""
    return "".join(json.dumps(kind) + "," for kind in path)


def placed_blocks(root: Element) -> tuple[list[str], list[str]]:
    """Places and texts of a page's blocks, in page order, without dropped parts."""
    places, texts, held = [], [], []

    def end(at: str) -> None:
        flush(texts, held)
        places.extend([at] * (len(texts) - len(places)))

    def walk(e: Element, at: str) -> None:
        for c in e.children:
            if isinstance(c, str):
                held.append(c)
            elif c.dropped:
                held.append(" ") if c.tag in INLINE else end(at)
            elif c.tag == "br":
                held.append(" ")
            elif c.tag in INLINE:
                walk(c, at)
            else:
                end(at)
                inner = at + place([kind_of(c)])
                walk(c, inner)
                end(inner)

    at = place([kind_of(root)])
    walk(root, at)
    end(at)
    return places, texts


def cut(places: list[str], texts: list[str], paths: list[list[str]]) -> str:
    """The blocks at the paths."""
    heads = tuple(map(place, paths))
    return "\n\n".join(text for at, text in zip(places, texts) if at.startswith(heads))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, signature, expression, places, texts of every page (empty ones: null from signature on).

    The expression (JSON, digests for long texts) is the page's own; places and texts are its blocks.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for page in batch["html"].tolist():
                if not page:
                    rows.append((None, None, None, None))
                    continue
                tree = parse(page)
                own = expression(tree)
                rows.append((signature(own), json.dumps(short(own)), *placed_blocks(tree)))
            read_ = pd.DataFrame(rows, columns=["signature", "expression", "places", "texts"])
            yield pd.concat([batch[["page_id", "url", "host"]].astype({"page_id": "Int64"}).reset_index(drop=True), read_], axis=1)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    path = shared_path(pages.sparkSession, "pages-read")
    rows.mapInPandas(read, "page_id long, url string, host string, signature string, expression string, places array<string>, texts array<string>").write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.parquet(path)


def infer_wrappers(read: DataFrame) -> DataFrame:
    """host, signature, paths, fixed (JSON): region and fixed texts of the wrapper of all pages of a signature.

    Expressions of n pages are merged in about sqrt(n) shares of as many, then the shares' wrappers,
    each in the order of their hashes: the partitions don't decide the result.
    """
    rows = read.where(F.col("expression").isNotNull()).select("host", "signature", "expression").distinct().withColumn("key", F.xxhash64("expression"))
    rows = checkpointed(rows)
    counts = checkpointed(rows.groupBy("host", "signature").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("shares")))
    rows = rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_HOSTS else counts, ["host", "signature"])
    rows = rows.withColumn("share", F.pmod("key", "shares")).withColumn("n", F.lit(1).cast("long"))

    def merge(group: pd.DataFrame) -> list:
        wrapper = None
        for text in group.sort_values(["key", "expression"])["expression"]:
            one = json.loads(text)
            wrapper = one if wrapper is None else merged(wrapper, one, "1")
        return wrapper

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return pd.DataFrame({"host": [first["host"]], "signature": [first["signature"]], "key": [first["share"]], "expression": [json.dumps(merge(group))], "n": [len(group)]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = merge(group)
        fixed = sorted(fixed_texts(wrapper)) if group["n"].sum() > 1 else []
        return pd.DataFrame({"host": [group["host"].iloc[0]], "signature": [group["signature"].iloc[0]], "paths": [json.dumps(region(wrapper))], "fixed": [json.dumps(fixed)]})

    some = rows.groupBy("host", "signature", "share").applyInPandas(shared, "host string, signature string, key long, expression string, n long")
    return some.groupBy("host", "signature").applyInPandas(whole, "host string, signature string, paths string, fixed string")


def page_text(places: list[str], texts: list[str], own: list, paths: list[list[str]], fixed: set[str]) -> str:
    """The main text of a page by its wrapper's region, and by its own where no article decides."""
    if by_articles(paths):
        return cut(places, texts, paths)
    every = [*paths, *region(without(own, fixed)), *articles_of_links(own)]
    return cut(places, texts, every) or cut(places, texts, region(own))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html, and pages without a main text, give the empty text; null urls and urls
    without a host form one host; repeated rows give equal rows; an empty table gives none; other
    columns are ignored. Unclosed elements end with the element around them or with the page.
    """
    small_batches(pages.sparkSession)
    read = read_pages(pages)
    wrappers = checkpointed(infer_wrappers(read))
    done = read.where(F.col("signature").isNull()).select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    rest = read.where(F.col("signature").isNotNull()).join(F.broadcast(wrappers) if wrappers.count() <= BROADCAST_HOSTS else wrappers, ["host", "signature"])

    def texts(batches):
        for batch in batches:
            known = {}  # a batch has few wrappers
            out = []
            for places, words, own, paths, fixed in zip(batch["places"], batch["texts"], batch["expression"], batch["paths"], batch["fixed"]):
                if (paths, fixed) not in known:
                    known[paths, fixed] = json.loads(paths), set(json.loads(fixed))
                out.append(page_text(places, words, json.loads(own), *known[paths, fixed]))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    return done.unionByName(rest.select("page_id", "url", "places", "texts", "expression", "paths", "fixed").mapInPandas(texts, "page_id long, url string, text string, n_chars long"))
