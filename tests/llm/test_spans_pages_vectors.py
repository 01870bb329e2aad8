import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import near_dedup, personal_data, vector_search, wrappers
from tests.llm.cases import ROWS, clashing, docs, key

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
            if [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-_+ 0123456789()é", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert personal_data.base_spans(text) == plain(text)


def test_long_runs_stay_linear():
    for text in ("a" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "@a" * 50_000, "9" * 200_000):
        personal_data.all_spans(text, np.zeros(30))


def test_personal_data_cases(spark):
    text = "mail a.b@x.example.com, card 4111 1111 1111 1111, +1 (212) 555-0123, 10.0.0.1; jane (at) example (dot) org"
    frame = docs(spark, [*ROWS, (20, text, "en", "a", 1)])
    weights = personal_data.fit(frame)
    rows = {r["doc_id"]: r for r in personal_data.find(frame, weights).collect()}
    r = rows[20]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert rows[3]["spans"] == rows[4]["spans"] == ""
    assert personal_data.find(clashing(spark), weights).count() == len(ROWS)
    assert personal_data.detect(docs(spark, [])).collect() == []


def test_personal_data_learns_from_every_candidate(spark):
    """The model is the one of all candidates: long documents, late spans and frequent votes count in full."""
    orders = "".join(f"order 4{i:015d}. " for i in range(1500))
    listing = "".join(f"item 10{i}.1.2.3.4, " for i in range(45)) + "".join(f"phone (212) 555-01{i:02d}; " for i in range(60))
    assert len(orders) > 20_000
    texts = [orders, listing, "mail bob (at) example (dot) org", "call +1 (212) 555-0123 or 030 1234 5678", "host 10.0.0.1 card 4111 1111 1111 1111 a@b.example", "x" * 300 + "@example.com"]
    spans = [(t, *s) for t in texts for s in sorted(set(personal_data.base_spans(t)) | set(personal_data.candidates(t)))]
    votes = np.array([personal_data.votes(t, a, kind, b) for t, a, kind, b in spans])
    kinds, lengths = np.array([s[2] for s in spans]), np.array([s[3] - s[1] for s in spans])
    frame = docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    assert np.allclose(personal_data.fit(frame), personal_data.train(votes, kinds, lengths), atol=1e-6)
    assert personal_data.fit(frame.where("doc_id = 2")) is not None


def test_personal_data_counts_are_weights():
    rng = np.random.default_rng(0)
    v, kinds, lengths = rng.integers(-1, 2, (40, 5)), rng.integers(0, 4, 40), rng.integers(5, 40, 40)
    n = rng.integers(1, 3000, 40)
    each = [np.repeat(a, n, axis=0) for a in (v, kinds, lengths)]
    assert np.allclose(personal_data.em(v, kinds, n), personal_data.em(*each[:2])[np.cumsum(n) - 1], atol=1e-9)
    assert np.allclose(personal_data.train(v, kinds, lengths, n), personal_data.train(*each), atol=1e-6)
    assert np.isfinite(personal_data.train(v, kinds, lengths, n * 1e9)).all()


PAGE = "<html><head><title>T &amp; x</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li>menu {i}</ul></nav><div class='ad'>buy {i}</div>{open}<h1>Head {i}</h1><p>One&nbsp; &eacute; {i}<br>two<p>Three <b>bold {i}</b> text<aside>side {i}</aside><section class='comments'><p>reader {i}</p></section>{close}<footer>foot {i}</footer>"
WANT = "Head {i}\n\nOne é {i} two\n\nThree bold {i} text"


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='story'>", "</div>")])
def test_wrapper_finds_the_article(around):
    pages = [PAGE.replace("{open}", around[0]).replace("{close}", around[1]).replace("{i}", str(i)) for i in range(5)]
    paths = wrappers.region(wrappers.infer(pages[:3]))
    for i, page in enumerate(pages):
        assert wrappers.extract(page, paths) == WANT.replace("{i}", str(i))
    assert wrappers.extract(None, paths) == wrappers.extract("", paths) == ""


def test_expression_has_repeats_options_and_slots():
    w = wrappers.infer(["<body><ul><li>a<li>b</ul><p>x</p></body>", "<body><ul><li>c</ul><hr><p>x</p></body>"])
    body = w[3][0]
    kinds = {c[0]: c[1] for c in body[3]}
    assert kinds == {"ul": "1", "hr": "?", "p": "1"} and body[3][0][3][0][:2] == ["li", "+"]
    assert body[3][0][3][0][3][0][3][0] is None and next(c for c in body[3] if c[0] == "p")[3][0][3][0] == "x"


def test_extract_cases(spark):
    page = PAGE.replace("{open}", "<article>").replace("{close}", "</article>")
    rows = [(i, "http://a.example/x" if i % 2 else None, page.replace("{i}", str(i))) for i in range(6)] + [(7, "http://a.example/", None), (7, "u", ""), (None, None, "<p")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS paths", "'z' AS text")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(frame).collect()}
    assert got == {**{i: WANT.replace("{i}", str(i)) for i in range(6)}, 7: "", None: ""}
    assert wrappers.extract_main_text(frame.limit(0)).collect() == []


def test_templates_beyond_eight_pages_keep_their_text(spark):
    """Hosts with many pages of one template and few of others: every template's text stays."""
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows, want = [], {}

    def add(host, body, *texts):
        i = len(rows)
        rows.append((i, f"http://{host}/{i}", f"<html><body>{body}</body></html>"))
        want[i] = "\n\n".join(texts)

    for i in range(60):
        add("a.example", f"<article><p>{words(i, 30)}</p></article>", words(i, 30))
        add("b.example", f"<div class='story'><p>{words(i, 30)}</p></div><div class='legal'><p>{'fixed ' * 40}</p></div>", words(i, 30))
    add("a.example", f"<article></article><div class='entry'><p>{words(100, 20)}</p></div>", words(100, 20))
    add("a.example", f"<article><p>{words(101, 20)}</p></article><article class='late'><p>{words(102, 20)}</p></article>", words(101, 20), words(102, 20))
    add("a.example", f"<section><article><p>{words(103, 20)}</p></article></section><article><p>{words(104, 20)}</p></article>", words(103, 20), words(104, 20))
    add("a.example", "<article><ul><li><a href='x'>only links</a></li></ul></article>", "only links")
    add("b.example", f"<div class='story'><p>{words(105, 20)}</p></div><div class='update'><p>{words(106, 20)}</p></div>", words(105, 20), words(106, 20))
    for i in (110, 120):
        add("b.example", f"<div class='story'><p>{words(i, 20)}</p></div><div class='note'><p>{words(i + 1, 20)}</p></div>", words(i, 20), words(i + 1, 20))
    add("b.example", f"<div class='story' hidden><p>no</p></div><div class='story'><p>{words(130, 20)}</p></div>", words(130, 20))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(frame).collect()}
    assert got == want
    assert {r["page_id"]: r["text"] for r in wrappers.extract_main_text(frame.repartition(7, "url")).collect()} == want


def test_articles_come_by_their_wrapper(spark):
    """Pages with an article have wrappers like all others, and it is their region that is cut."""
    page = "<html><body><div class='top'>site</div><span><div class='in'><article class='a'><h1>T{i}</h1><p>one {i}</p></article></div></span></body></html>"
    rows = [(i, "http://c.example/", page.replace("{i}", str(i))) for i in range(9)] + [(9, "http://c.example/", "<body><main><p>m</p></main></body>"), (10, None, "")]
    read = wrappers.read_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert read.where("signature IS NOT NULL AND expression IS NOT NULL").count() == 10
    found = {r["paths"] for r in wrappers.infer_wrappers(read).collect()}
    assert found == {'[["html", "body", "div.in", "article.a"]]', '[["html", "body", "main"]]'}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {**{i: f"T{i}\n\none {i}" for i in range(9)}, 9: "m", 10: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_top_k_cases(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(90, None), (91, [1.0, None]), (92, [float("nan")] * 6), (93, [float("inf")] * 6), (94, []), (95, [1e30] * 3), (20, [1.0] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS part", "2 AS uid", "3 AS score")
    use = [(i, np.clip(np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))), -(2.0**28), 2.0**28)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(use):
        if i % 20 == 0:
            others = sorted((-(q @ v), j) for b, (j, v) in enumerate(use) if b != a)[:20]
            want += [(i, r + 1, j, int(-s)) for r, (s, j) in enumerate(others)]
    assert key(vector_search.top_k(frame).collect()) == key(want)
    assert vector_search.top_k(frame.limit(0)).collect() == []


def test_near_duplicates_cases(spark):
    base = [f"w{i}" for i in range(60)]
    near = [(100 + n, " ".join([*base[:n], "X", *base[n + 1 :]]), "en", "a", 0) for n in (0, 20, 40, 59)]
    rows = [*ROWS, *near, (200, "a a", "en", "a", 0), (201, "A  A", "en", "a", 0)]
    frame = docs(spark, rows)
    sets, ids = [], [r[0] for r in rows]
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(set(zip(w, w[1:])) or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min((ids[i] for i in range(len(rows)) if group[i] == g and ids[i] is not None), default=None) for g in set(group)}
    want = [(ids[i], len(sets[i]), low[group[i]], ids[i] == low[group[i]]) for i in range(len(rows))]
    assert key(near_dedup.near_duplicates(frame, k=2).collect()) == key(want)
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []
    assert near_dedup.keep_one_of_each(clashing(spark)).columns == clashing(spark).columns


def test_near_copies_below_the_threshold_are_not_paired_one_by_one(spark, monkeypatch):
    """Many variants of one text that aren't linked: their bucket compares them, no join of all pairs does."""
    monkeypatch.setattr(near_dedup, "LARGE", 16, raising=False)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 4000, raising=False)
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = np.random.default_rng(7)
    texts = []
    for v in range(150):
        words = [f"w{i}" for i in range(200)]
        for at in rng.choice(200, 8, replace=False):
            words[at] = f"v{v}x{at}"
        texts.append(" ".join(words))
    for v in (3, 70, 149):  # a link of each with its source
        texts += [texts[v].replace("w1 ", "w1 extra ", 1), texts[v].replace("w190 ", "w190 more ", 1)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    sets = [set(zip(w, w[1:])) for w in (t.split() for t in texts)]
    ids = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and ids[i] != ids[j]:
                low, high = sorted((ids[i], ids[j]))
                ids = [low if x == high else x for x in ids]
    pairs = []
    confirm = near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda p, *rest: (pairs.append(p.count()), confirm(p, *rest))[1])
    got = near_dedup.near_duplicates(docs(spark, rows), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(ids)) and len(set(ids)) < len(ids)
    assert sum(pairs) < 5000  # of 12,090
