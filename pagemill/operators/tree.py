"""The element tree of a page as arrays beside its tokens.

One stack per page closes elements as HTML does: an end tag closes what its element holds, and ``p``,
``li``, ``td``, headings and friends end where the next one begins. The fold sees tag names
only (``marks``); texts, attributes and URLs never leave the JVM. It returns narrow arrays: for
each token its block, what it renders as and the formatting that opens before and closes
after it; for each block its context; for each container the blocks where it begins and ends.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.options import DEFAULT, Options

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
LEVEL_TAGS = ("body", "div", "section", "article", "main", "ul", "ol")
LIST_TAGS = ("ul", "ol")
REGION_TAGS = ("article", "main")
CONTAINER_TAGS = ("body", "div", "section")
HEAD_TAGS = ("title", "meta", "link", "script", "style", "base", "noscript", "template", "x-removed", "head", "html")
# Open tags that end an open paragraph.
ENDS_P = frozenset(BLOCK_TAGS) - {"body", "html", "li", "dd", "dt", "tbody", "tfoot", "thead", "tr", "td", "th"} | {"li", "dd", "dt"}
BARRIERS = frozenset(("table", "td", "th", "caption", "html"))

# What a token renders as.
NOTHING, TEXT, RAW, CODE_TEXT, BREAK, IMAGE, CHECKBOX, RULE, FIRST_CELL, CELL = range(10)
# Flags of a token.
EXCLUDED, CHROME, IN_LINK, LINE_START = 1, 2, 4, 8
# Separators inside a cell: an inner cell's and an inner row's, paragraph's or line's.
CELL_BREAK, ROW_BREAK, LINK = "|", "/", "a"

TOKEN = pa.struct([("b", pa.int32()), ("k", pa.int8()), ("f", pa.int8()), ("lvl", pa.int16()), ("a", pa.int32()), ("ref", pa.int32()), ("pre", pa.string()), ("post", pa.string())])
BLOCK = pa.struct([("blk", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("s_tag", pa.string()), ("s_dir", pa.int8()), ("chrome", pa.bool_()), ("region", pa.int32()),
                   ("q", pa.int16()), ("list", pa.int16()), ("li", pa.int32()), ("num", pa.int64()), ("h", pa.int8()), ("pre", pa.bool_()), ("tbl", pa.int32()), ("row", pa.int32()),
                   ("cells", pa.int32()), ("code", pa.int32())])
SPAN = pa.struct([("kind", pa.string()), ("pos", pa.int32()), ("parent", pa.int32()), ("o", pa.int32()), ("c", pa.int32()), ("end", pa.int32())])
REF = pa.struct([("pos", pa.int32()), ("n", pa.int32())])
PAGE = pa.struct([("tokens", pa.list_(TOKEN)), ("blocks", pa.list_(BLOCK)), ("spans", pa.list_(SPAN)), ("refs", pa.list_(REF)),
                  ("metas", pa.list_(pa.int32())), ("title", REF), ("markup", pa.bool_())])
PAGE_SQL = ("struct<tokens: array<struct<b: int, k: tinyint, f: tinyint, lvl: smallint, a: int, ref: int, pre: string, post: string>>, "
            "blocks: array<struct<blk: int, first: int, n: int, s_tag: string, s_dir: tinyint, chrome: boolean, region: int, q: smallint, list: smallint, li: int, num: bigint, "
            "h: tinyint, pre: boolean, tbl: int, row: int, cells: int, code: int>>, "
            "spans: array<struct<kind: string, pos: int, parent: int, o: int, c: int, `end`: int>>, refs: array<struct<pos: int, n: int>>, "
            "metas: array<int>, title: struct<pos: int, n: int>, markup: boolean>")


class Element:
    __slots__ = ("tag", "kinds", "letter", "pos", "seg", "span", "ref", "next", "li", "num")

    def __init__(self, tag: str, kinds: tuple, letter: str, pos: int, seg: int):
        self.tag, self.kinds, self.letter, self.pos, self.seg = tag, kinds, letter, pos, seg
        self.span = self.ref = -1
        self.next = self.num = self.li = 0


def first_here(letter: str, elements: list[Element], seg: int) -> Element | None:
    """The outermost of a letter's open elements that formats in this segment: formatting ends with its
    block, a link goes on."""
    if not elements:
        return None
    if letter == LINK:
        return elements[0]
    at = bisect_left(elements, seg, key=lambda e: e.seg)
    return elements[at] if at < len(elements) else None


class Fold:
    """The grammar of one set of options; ``page`` folds one page's marks."""

    def __init__(self, opts: Options = DEFAULT):
        groups = {"chrome": opts.chrome_tags, "removed": tuple(opts.removed_tags) + tuple(t for r in opts.rules if r.remove for t in r.tags), "region": REGION_TAGS, "a": ("a",),
                  "pre": ("pre",), "q": ("blockquote",), "list": LIST_TAGS, "table": ("table",), "cell": CELL_TAGS, "h": HEADINGS,
                  "title": ("title",), "svg": ("svg",), "head": ("head",), "lvl": LEVEL_TAGS, "code": ("code",)}
        self.kinds = {}
        for kind, tags in groups.items():
            for t in tags:
                self.kinds[t] = (*self.kinds.get(t, ()), kind)
        self.groups = tuple(groups)
        self.letters = opts.letters()
        self.code = {letter for tag, letter in self.letters.items() if tag == "code"}
        self.chrome = frozenset(opts.chrome_tags)

    def page(self, marks: list[str]) -> dict:
        """The page's arrays. A nav, header, footer or aside that is never closed (its parent's end or the
        page's closes it) ends where an article or main begins in it, so it can't hide that."""
        unclosed: set[int] = set()
        while True:
            out, lost = self._fold(marks, unclosed)
            if lost <= unclosed:
                return out
            unclosed |= lost

    def _fold(self, marks: list[str], unclosed: set[int]) -> tuple[dict, set[int]]:
        tokens, blocks, spans, refs, metas = [], [], [], [], []
        depth = dict.fromkeys(self.groups, 0)
        stack: list[Element] = []
        where: dict[str, list[int]] = {}             # places in the stack, by tag
        solid: list[int] = []                        # places of blocks and cells
        chromed: list[int] = []                      # places of chrome elements
        doomed: list[int] = []                       # those of them that end at the next region
        spanned: list[Element] = []                  # open containers and regions
        formats: dict[str, list[Element]] = {}       # open elements that format, by letter
        blk = seg = region = li_seq = table_seq = 0
        row = cells = 0
        path: list[tuple] = []        # formatting of the last rendered core in this segment
        last_core = -1
        after_hr = line_start = seen = body = False
        pending = ""                  # separator due before the next core of a cell
        title = None
        markup = in_cell = excluded = False
        state = level = 0
        link = -1
        closing: list[Element] = []   # elements closed by the current token
        hiding: set[int] = set()      # open chrome elements that hold a region
        lost: set[int] = set()

        def close_formats(keep: int) -> None:
            if last_core >= 0 and len(path) > keep:
                tokens[last_core][7] = "".join(letter for letter, _, _ in reversed(path[keep:]))
                for letter, _, ref in path[keep:]:
                    if letter == LINK:
                        tokens[last_core][5] = ref

        def leave(e: Element) -> None:
            where[e.tag].pop()
            for kind in e.kinds:
                depth[kind] -= 1
            if e.letter:
                formats[e.letter].pop()
            closing.append(e)

        def pop_to(at: int, named: int = -1) -> None:
            while len(stack) > at:
                e = stack.pop()
                if e is not None and e.pos in hiding:
                    hiding.discard(e.pos)
                    if len(stack) != named:
                        lost.add(e.pos)
                for places in (solid, chromed, doomed):
                    if places and places[-1] == len(stack):
                        places.pop()
                if e is not None:
                    leave(e)

        def last(tags) -> int:
            """The place of the innermost open element of these tags, -1 if none is open."""
            return max((where[t][-1] for t in tags if where.get(t)), default=-1)

        def find(tags, barriers=BARRIERS) -> int:
            at = last(tags)
            return at if at >= last(barriers) else -1

        for i, mark in enumerate(marks):
            tag = extra = ""
            is_open = is_close = False
            if mark not in ("t", "n", " ", "!"):
                is_close = mark[0] == "/"
                is_open = not is_close
                tag, _, extra = mark[is_close:].partition(":")
            if is_open:
                if depth["head"] and tag not in HEAD_TAGS and (tag == "body" or tag in BLOCK_TAGS):
                    pop_to(find(("head",), ()))
                if tag in ENDS_P and (at := find(("p",))) >= 0:
                    pop_to(at)
                if tag == "li":
                    if (at := find(("li",), BARRIERS | {"ul", "ol", "menu", "dir"})) >= 0:
                        pop_to(at)
                elif tag in ("dd", "dt"):
                    if (at := find(("dd", "dt"), BARRIERS | {"dl"})) >= 0:
                        pop_to(at)
                elif tag in HEADINGS:
                    if stack and last(HEADINGS) == len(stack) - 1:
                        pop_to(len(stack) - 1)
                elif tag in CELL_TAGS and depth["table"]:
                    at = find(("tr", "table"), ())
                    pop_to(at + 1)
                elif tag == "tr" and depth["table"]:
                    pop_to(find(("table", "tbody", "thead", "tfoot"), ()) + 1)
                elif tag in ("tbody", "thead", "tfoot") and depth["table"]:
                    pop_to(find(("table",), ()) + 1)
                elif tag == "a" and depth["a"] and (at := find(("a",))) >= 0:
                    pop_to(at)
                elif tag == "option" and stack and last(("option",)) == len(stack) - 1:
                    pop_to(len(stack) - 1)
                if tag in REGION_TAGS and depth["chrome"]:
                    if doomed:
                        pop_to(doomed[0])
                    for at in reversed(chromed):
                        if stack[at].pos in hiding:
                            break
                        hiding.add(stack[at].pos)
                if tag == "body":
                    body = True
                if tag not in VOID_TAGS and not (tag in ("html", "body") and where.get(tag)):
                    e = Element(tag, self.kinds.get(tag, ()), self.letters.get(tag, LINK if tag == "a" else ""), i, seg)
                    owner = last(LIST_TAGS)
                    where.setdefault(tag, []).append(len(stack))
                    if tag in BLOCK_TAGS or tag in CELL_TAGS:
                        solid.append(len(stack))
                    if tag in self.chrome:
                        chromed.append(len(stack))
                        if i in unclosed:
                            doomed.append(len(stack))
                    stack.append(e)
                    for kind in e.kinds:
                        depth[kind] += 1
                    if tag in LIST_TAGS:
                        e.next = int(extra) if extra else 1
                    elif tag == "li":
                        li_seq += 1
                        e.li, e.num = li_seq, -1
                        if owner >= 0 and stack[owner].tag == "ol":
                            e.num, stack[owner].next = stack[owner].next, stack[owner].next + 1
                    elif tag == "table" and depth["table"] == 1:
                        table_seq += 1
                        row = 0
                    if tag in REGION_TAGS and depth["region"] == 1:
                        region += 1
                    if e.letter:
                        formats.setdefault(e.letter, []).append(e)
            elif is_close and tag not in VOID_TAGS:
                if tag in HEADINGS:
                    at = find(HEADINGS)
                elif tag in ("body", "html", "table"):
                    at = find((tag,), ())
                elif tag in CELL_TAGS or tag in TABLE_STRUCT:
                    at = find((tag,), ("table",))
                elif tag in ("li",):
                    at = find((tag,), BARRIERS | {"ul", "ol"})
                elif tag in BLOCK_TAGS or tag in ("head", "title", "svg"):
                    at = find((tag,))
                else:
                    at = last((tag,))
                    if at >= 0 and solid and solid[-1] > at:
                        leave(stack[at])  # an inline end tag ends its element, not the blocks begun in it
                        stack[at], at = None, -1
                if at >= 0:
                    pop_to(at, at)
            outer_cell = False
            if tag or after_hr or not blocks:
                in_cell = depth["cell"] > 0
                boundary = after_hr or (tag in BLOCK_TAGS and (not depth["pre"] or tag == "pre") and not in_cell)
                after_hr = is_open and tag == "hr"
                outer_cell = tag in CELL_TAGS and depth["table"] <= 1 and (not in_cell or (is_open and depth["cell"] == 1))
                if boundary or outer_cell:
                    close_formats(0)
                    path, last_core, line_start, seen, pending = [], -1, True, False, ""
                    seg += 1
                elif in_cell and seen and (is_open or is_close):
                    if tag in CELL_TAGS and is_open:
                        pending = pending or CELL_BREAK
                    elif tag in BLOCK_TAGS or tag == "br":
                        pending = ROW_BREAK
                if boundary:
                    blk += 1
                    cells = 0
                if is_open and tag == "tr" and depth["table"] == 1 and not in_cell:
                    row += 1
                excluded = depth["head"] or depth["title"] or depth["removed"]
                if boundary or not blocks:
                    li = stack[where["li"][-1]] if where.get("li") else None
                    h = int(stack[last(HEADINGS)].tag[1]) if depth["h"] else 0
                    blocks.append([blk, i, 0, tag, is_open - is_close, depth["chrome"] > 0, region if depth["region"] else 0, depth["q"], depth["list"],
                                   li.li if li else 0, li.num if li else None, h, depth["pre"] > 0, table_seq if depth["table"] else 0, row, 0, -1])
            block = blocks[-1]
            block[2] += 1
            if tag:
                if is_open and tag in CONTAINER_TAGS + REGION_TAGS and (tag in CONTAINER_TAGS or depth["region"] == 1) and stack and stack[-1].pos == i:
                    stack[-1].span = len(spans)
                    while spanned and spanned[-1].span < 0:
                        spanned.pop()
                    spans.append(["region" if tag in REGION_TAGS else "container", i, spanned[-1].span if spanned else -1, blk, None, None])
                    spanned.append(stack[-1])
                for e in closing:
                    if e.span >= 0:
                        spans[e.span][4:], e.span = [blk, i], -1
                    if e.ref >= 0:
                        refs[e.ref][1] = i - refs[e.ref][0]
                    if e.tag == "title" and title is not None and title[0] == e.pos:
                        title[1] = i - e.pos
                closing.clear()
                if is_open and tag == "title" and title is None and not depth["svg"]:
                    title = [i, -1]
                if tag == "meta" and is_open and not body:
                    metas.append(i)
            if not markup and not excluded and not depth["chrome"] and ((tag and tag not in ("html", "head", "body") and tag not in self.chrome) or mark == "t"):
                markup = True
            kind, pre, ref = NOTHING, "", -1
            core = False
            if excluded:
                pass
            elif mark in ("t", "n", " "):
                if depth["pre"] and not in_cell:
                    kind = RAW
                elif mark == " ":
                    kind = TEXT
                else:
                    kind, core = TEXT, True
            elif is_open and depth["pre"] and not in_cell:
                kind = BREAK if tag == "br" else NOTHING
                if tag == "code" and block[16] < 0:
                    block[16] = i
            elif is_open and tag == "br":
                kind, line_start = (NOTHING if in_cell else BREAK), True
            elif is_open and tag == "img" and extra:
                kind, core, ref = IMAGE, True, len(refs)
                refs.append([i, 0])
            elif is_open and tag == "input" and extra:
                kind, core = CHECKBOX, True
            elif is_open and tag == "hr" and not in_cell:
                kind = RULE
            elif outer_cell and is_open and depth["table"] == 1:
                if not cells and block[3] != "tr":
                    row += 1
                    block[14] = row
                cells += 1
                block[15] = cells
                kind = FIRST_CELL if cells == 1 else CELL
            if is_open and tag == "a" and not excluded:
                stack[-1].ref = len(refs)
                refs.append([i, -1])
                if not extra:  # without a target: no formatting
                    formats[stack[-1].letter].pop()
                    stack[-1].letter = ""
            if tag:
                state = (EXCLUDED if excluded else 0) | (CHROME if depth["chrome"] else 0) | (IN_LINK if depth["a"] else 0)
                link = stack[where["a"][-1]].ref if depth["a"] else -1
                level = depth["lvl"]
            flags = state
            if core:
                held = [(x.pos, x) for letter, es in formats.items() if (x := first_here(letter, es, seg)) is not None]
                now = []
                for _, e in sorted(held, key=lambda h: h[0]):
                    now.append((e.letter, e.pos, e.ref))
                    if e.letter in self.code:
                        kind = CODE_TEXT if kind == TEXT else kind
                        break
                same = 0
                if not pending:
                    while same < min(len(now), len(path)) and now[same][:2] == path[same][:2]:
                        same += 1
                close_formats(same)
                pre = pending + "".join(letter for letter, _, _ in now[same:])
                path, last_core, pending, seen = now, i, "", True
                flags |= LINE_START if line_start else 0
                line_start = False
            tokens.append([blk, kind, flags, level, link, ref, pre, ""])
        close_formats(0)
        for e in filter(None, stack):
            if e.ref >= 0:
                refs[e.ref][1] = len(marks) - refs[e.ref][0]
            if e.tag == "title" and title is not None and title[0] == e.pos:
                title = None  # never closed: no title
        return {"tokens": tokens, "blocks": blocks, "spans": spans, "refs": refs, "metas": metas, "title": title, "markup": markup}, lost | hiding


def _structs(rows: list[list], kind: pa.StructType) -> pa.StructArray:
    columns = list(zip(*rows)) if rows else [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(c, kind.field(k).type) for k, c in enumerate(columns)], fields=list(kind))


def _lists(pages: list[dict], name: str, kind: pa.DataType) -> pa.ListArray:
    ends, rows = [0], []
    for p in pages:
        rows += p[name]
        ends.append(len(rows))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(rows, kind) if pa.types.is_struct(kind) else pa.array(rows, kind))


#: Pages whose rows are held as Python lists at once.
GROUP = 64


def _arrays(pages: list[dict]) -> pa.StructArray:
    title = pa.StructArray.from_arrays([pa.array([p["title"] and p["title"][k] for p in pages], pa.int32()) for k in (0, 1)], fields=list(REF))
    return pa.StructArray.from_arrays([
        _lists(pages, "tokens", TOKEN), _lists(pages, "blocks", BLOCK), _lists(pages, "spans", SPAN), _lists(pages, "refs", REF),
        _lists(pages, "metas", pa.int32()), title, pa.array([p["markup"] for p in pages], pa.bool_())], fields=list(PAGE))


def page_trees(opts: Options = DEFAULT):
    """A column function: marks (array of strings) -> the page's arrays (``PAGE_SQL``)."""
    @F.arrow_udf(PAGE_SQL)
    def trees(marks: pa.Array) -> pa.Array:
        fold = Fold(opts)
        parts = [_arrays([fold.page(m or []) for m in marks.slice(at, GROUP).to_pylist()]) for at in range(0, max(1, len(marks)), GROUP)]
        return pa.concat_arrays(parts)

    return trees
