import glob
import hashlib
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import collocations, decontamination, oracles_sql, transducer, whitening, wordarrays
from pagemill.llm.transducer import Transducer, summed
from tests.llm.cases import ROWS, clashing, docs, key

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# --- phrases ------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.lists(st.integers(0, 5), min_size=1, max_size=5).map(tuple), st.integers(1, 9), max_size=60))
def test_transducer_maps_phrases_to_counts(counts):
    grams = np.full((len(counts), 5), -1, np.int64)
    for i, g in enumerate(counts):
        grams[i, : len(g)] = g
    grams, n = summed(grams, np.array(list(counts.values()), np.int64))
    t = Transducer.unpack(Transducer.build(grams, n).pack())
    got, weights = t.paths()
    assert {tuple(x for x in g if x >= 0): int(w) for g, w in zip(got.tolist(), weights)} == counts
    assert t.weigh(grams).tolist() == n.tolist()
    assert t.weigh(np.array([[9, -1, -1, -1, -1], [0, 9, -1, -1, -1]])).tolist() == [0, 0]
    both = Transducer.union([t, t, Transducer.build(grams[:0], n[:0])], least=6)
    assert dict(zip(map(tuple, np.pad(both.paths()[0], ((0, 0), (0, 5 - both.paths()[0].shape[1])), constant_values=-1).tolist()), both.paths()[1].tolist())) == {tuple(g): 2 * w for g, w in zip(grams.tolist(), n.tolist()) if 2 * w >= 6}


def test_equal_endings_share_states():
    grams = np.array([[a, b, c] for a in range(20) for b in range(10) for c in range(10)], np.int64)
    t = Transducer.build(grams, np.full(len(grams), 7, np.int64))
    assert len(t.final) == 4 and len(t.label) == 40


def test_union_of_many_parts_holds_few_rows_at_once(monkeypatch):
    monkeypatch.setattr(transducer, "PORTION", 20_000, raising=False)
    grams = np.array([[a, b] for a in range(100) for b in range(100)], np.int64)
    data = Transducer.build(grams, np.arange(1, 10_001)).pack()
    wider = Transducer.build(np.array([[3, 4, 5]]), np.array([7])).pack()
    tracemalloc.start()
    try:
        t = Transducer.union((Transducer.unpack(d) for d in [*[data] * 40, wider, *[data] * 40]), least=81)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12 << 20  # 81 parts at once take 48 MB and more
    got, counts = t.paths()
    assert got.shape == (9_999, 2) and counts.tolist() == list(range(160, 800_001, 80))
    assert Transducer.union([], least=1).paths()[1].tolist() == []


def phrases_plainly(rows, least, top):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for size in range(1, 6):
                for i in range(len(ws) - size + 1):
                    c[tuple(ws[i : i + size])] += 1
    for lang, c in f.items():
        cands = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        hidden = {g[i:j] for g in cands for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and cands[g] >= c[g[i:j]]}
        found = []
        for g, a in cands.items():
            if g not in hidden:
                score, k = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), " ".join(g), c[g[:k]], c[g[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("fan", [2, 32])
def test_phrases_as_plain_counts(spark, monkeypatch, fan):
    monkeypatch.setattr(collocations, "FAN", fan)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 2000)
    rng = np.random.default_rng(5)
    words = ["a", "ab", "b\x01", "É", "new", "york", "x\x0b", "\x00", "times", "of"]
    texts = [(" ".join(rng.choice(words, 30, p=[0.2, 0.05, 0.05, 0.1, 0.2, 0.2, 0.02, 0.03, 0.05, 0.1])) + rng.choice([".", "\n", ", ", "\t"]) + "New York Times of", ["en", "fr", None][i % 3]) for i in range(150)]
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(texts)] + [r for r in ROWS if r[0] != 6]
    want = phrases_plainly([(r[1], r[2]) for r in rows], 6, 40)
    got = collocations.mine(docs(spark, rows).repartition(5), least=6, top=40)
    assert key(got.collect()) == key(want) and len(want) > 60
    assert key(collocations.mine(clashing(spark, rows), least=6, top=40).collect()) == key(want)
    assert collocations.mine(docs(spark, []), least=2).collect() == []
    assert collocations.mine(docs(spark), least=10**9).collect() == []


def test_phrases_are_the_same_whatever_the_partitions(spark):
    """Joins of wide and of narrow rows, which Spark cuts into other partitions, agree on what a row is."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 40) % 50), ["en", "fr", None][i % 3], "s", 0) for i in range(600)]
    want = phrases_plainly([(r[1], r[2]) for r in rows], 5, 10**6)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
             "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        got = collocations.mine(docs(spark, rows), least=5, top=10**6).collect()
    finally:
        for name in small:
            spark.conf.unset(name)
    assert key(got) == key(want) and len(want) > 500


def test_cells_are_finer_where_there_are_more_documents(spark, monkeypatch):
    """A cell holds the phrases of about CELL words of the documents, however many documents there are."""
    monkeypatch.setattr(collocations, "CELL", 250, raising=False)
    monkeypatch.setattr(collocations, "FAN", 8)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 4000)
    rng = np.random.default_rng(17)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 120, 40)), "en", "s", 0) for i in range(400)]
    words, cells, _, bounds = collocations.phrases(docs(spark, rows), least=2)
    sizes = [(Transducer.unpack(r["packed"]).paths()[0][:, 1:2] >= 0).sum() for r in cells.collect()]
    cores = spark.sparkContext.defaultParallelism
    assert words.count() == 120 and len(bounds) == max(8, int(np.ceil(np.sqrt(2 * cores)))) - 1  # 64 cells of 250 words, or two for each core
    assert sum(sizes) > 3000 and max(sizes) < sum(sizes) / 20
    want = phrases_plainly([(r[1], r[2]) for r in rows], 2, 50)
    assert key(collocations.mine(docs(spark, rows), least=2, top=50).collect()) == key(want)


# --- whitening -----------------------------------------------------------------
@pytest.mark.parametrize("values", [np.linspace(1, 9, 24), [5, 5, 5, 1, 1, 0.5, 0, 0], [1e9, 1, 1e-2, 1e-3], [3], np.ones(20), np.geomspace(1, 1e-9, 30)])
def test_slices_hold_the_leading_eigenpairs(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))[0]
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.leading(v, 16)
    want = np.sort(np.array(values, float))[::-1]
    want = want[want > 2e-12 * want[0]][:16]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.allclose(x @ x.T, np.eye(len(x)), atol=1e-9)
    assert np.allclose(v @ x.T, x.T * e, atol=1e-11 * want[0])
    for s in (0.3, 0.7 * want[0], 2 * want[0]):
        assert whitening.above(v, s) == (np.linalg.eigvalsh(v) > s).sum()
    assert len(whitening.leading(np.zeros((4, 4)))[0]) == 0


def test_whitening_cases(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(80, 5)) * [3, 2, 1, 0.5, 0.25]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (200, vectors[7]), (None, vectors[9]), (90, None), (91, [1.0, None]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, []), (95, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS x", "'a' AS component")
    kept = [(i, np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 5 - len(v)))) + 1_000_000) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    cov = z.T @ z / n
    e, basis = np.linalg.eigh(cov)
    e, basis = e[::-1], basis.T[::-1]
    got = whitening.whiten(frame).collect()
    assert len(got) == 5 * len(kept)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-6
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"], r["explained"]))
    for c, found in by.items():
        want = sorted((i if i is not None else -1, int(((n * x - s) ** 2).sum()), float((x - s / n) @ basis[c - 1] / e[c - 1] ** 0.5)) for i, x in kept)
        found.sort()
        assert [f[:2] for f in found] == [w[:2] for w in want]
        a, b = np.array([f[2] for f in found]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert abs(found[0][3] - e[c - 1] / e.sum()) < 1e-9
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.where("vec_id = 5")).collect() == []  # one vector has no variance
    big = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["deviation"]) for r in whitening.whiten(big).collect()} == {(1, None), (2, None), (3, 36864)}  # beyond a long: null


# --- decontamination ------------------------------------------------------------
def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def leaks_plainly(rows, items, n=10):
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            windows = {tuple(p[i : i + n]) for i in range(max(1, len(p) - n + 1))} if p else set()
            for g in windows:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "one two three four FIVE six seven eight nine ten eleven twelve"), (2, "Short item"), (10, "x x x x x x x x x x x x"), (10, "short item"), (3, None), (4, ""), (5, "..."), (6, "é1 ß"),
         (7, " ".join(f"w{i}" for i in range(40)))]
LEAKS = [
    (100, "zero one two three four five six seven eight nine ten eleven zwölf"), (101, "One-two.three four five six seven eight nine ten!"), (102, "one two three four five six seven eight nine"),
    (103, "a short\nitem, and a SHORT, item"), (104, "x " * 50), (105, "short"), (106, "item"), (107, "É1 ß é1 ß"), (108, " ".join(f"w{i}" for i in range(40))), (109, " ".join(f"w{i}" for i in range(5, 20))),
    (104, "x " * 9), (110, "\x7f{}"), (111, "Zebra " * 3000 + " ".join(f"w{i}" for i in range(12, 25)) + " y" * 3000)]


@pytest.mark.parametrize("small", [False, True])
def test_leaks_as_a_plain_search(spark, monkeypatch, small):
    if small:  # segments of few texts, several rounds, pieces and portions
        monkeypatch.setattr(decontamination, "ROUND", 20)
        monkeypatch.setattr(decontamination, "PIECE", 7)
        monkeypatch.setattr(decontamination, "CANDIDATES", 5)
    rows = [*ROWS, *((i, t, "en", "s", 0) for i, t in LEAKS)]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS item", "'y' AS words")
    want = leaks_plainly([(r[0], r[1]) for r in rows], ITEMS)
    got = decontamination.contamination(clashing(spark, rows).repartition(4), benchmark).drop("items")
    assert key(got.collect()) == key(want) and sum(w[5] for w in want) >= 6
    assert decontamination.contamination(docs(spark, []), benchmark).collect() == []
    assert not any(r["contaminated"] for r in decontamination.contamination(docs(spark, rows), benchmark.limit(0)).collect())


def test_index_is_made_and_read_in_small_pieces(spark, tmp_path, monkeypatch):
    """Segments and row groups are bounded by bytes; what cutting a text needs beside its words is bounded too."""
    path = str(tmp_path / "index")
    monkeypatch.setattr(decontamination, "shared_path", lambda *_: path)
    rng = np.random.default_rng(23)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 14_000)), "en", "s", 0) for i in range(90)]
    assert sum(len(r[1]) for r in rows) < 10 << 20
    index = decontamination.build_index(docs(spark, rows).coalesce(1))
    texts = {r[0]: len(r[1]) for r in rows}
    held = [sum(texts[i] for i in r["doc_ids"]) for r in index.select("doc_ids").collect()]
    assert sum(held) == sum(texts.values()) and max(held) <= 2 << 20
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in glob.glob(f"{path}/*.parquet") for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) >= 3 and max(g.num_rows for g in groups) <= 2 and sum(g.num_rows for g in groups) == len(held)
    monkeypatch.undo()
    got = decontamination.contamination(docs(spark, rows[:3]), spark.createDataFrame([("x", rows[1][1][:200])], "item_id string, text string"))
    assert [(r["doc_id"], r["n_words"], r["contaminated"]) for r in got.orderBy("doc_id").collect()] == [(0, 14_000, False), (1, 14_000, True), (2, 14_000, False)]


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_texts_are_cut_alike_whatever_is_cut_at_once(monkeypatch, size):
    texts = pa.array(["x, y", "One two. three", None, "", ".", "a b\nc", " ", "É\x00 z.z", "tail"]).slice(1)
    want = [(w, i, b) for i, t in enumerate(texts.to_pylist()) for w, b in re_words(t or "")]
    monkeypatch.setattr(wordarrays, "SPLIT_BYTES", size, raising=False)
    got = wordarrays.split(texts, collocations.PIECES)
    assert list(zip([w.decode() for w in got.words.to_pylist()], got.text.tolist(), got.begins.tolist())) == want and got.texts == 8
    none = wordarrays.split(texts[:0], collocations.PIECES)
    assert len(none.words) == len(none.text) == none.texts == 0


def re_words(text):
    for piece in re.split("[.,;:!?\n-\r]", text.translate(LOWER)):
        for k, word in enumerate(re.findall("[^ \t]+", piece)):
            yield word, not k


def test_proximity_matches(spark):
    rows = [(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha gamma beta"), (4, "alpha x x x beta gamma"), (5, "beta alpha")]
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hit = lambda slop: {r["doc_id"] for r in decontamination.contamination(frame, items, slop=slop).collect() if r["contaminated"]}
    assert hit(0) == {1} and hit(1) == {1, 2, 3} and hit(3) == {1, 2, 3, 4}


def test_sql_of_phrases_and_leaks(spark, sf001):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    frame, benchmark = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "benchmark"))
    for got, sql in ((collocations.mine(frame), oracles_sql.COLLOCATIONS), (decontamination.contamination(frame, benchmark).drop("items"), oracles_sql.DECONTAMINATION)):
        assert key(got.collect()) == key(con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())
