import zlib

import numpy as np

from pagemill.llm import language_id, toxicity
from tests.llm.cases import ROWS, clashing, docs


def by_brute_force(emission, starts, chain):
    out, n = [], len(emission)
    ends = [*np.flatnonzero(starts)[1:], n]
    for lo, hi in zip(np.flatnonzero(starts), ends):
        e = np.exp(emission[lo:hi])
        m = [np.diag([1.0, x]) for x in e]
        ahead = [chain[2] @ m[0]]
        for x in m[1:]:
            ahead.append(ahead[-1] @ chain[:2] @ x)
        back = [np.ones(2)]
        for x in m[:0:-1]:
            back.append(chain[:2] @ x @ back[-1])
        for a, b in zip(ahead, back[::-1]):
            out.append((a * b)[1] / (a * b).sum())
    return np.array(out)


def test_marginals_against_plain_forward_backward():
    rng = np.random.default_rng(0)
    chain = np.array([[2.0, 0.3], [0.4, 0.7], [0.9, 0.1]])
    for sizes in ([1], [3, 1, 5], [300, 2, 700, 40]):
        n = sum(sizes)
        starts = np.zeros(n, bool)
        starts[np.cumsum([0, *sizes[:-1]])] = True
        emission = rng.normal(0, 1, n)
        assert np.allclose(toxicity.marginals(emission, starts, chain), by_brute_force(emission, starts, chain), atol=1e-9)
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, bool), chain)) == 0


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    p = language_id.train(rng.integers(0, 256, (40, language_id.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40), 3)
    e, pooled = p["embed"][x], []
    for w in language_id.WIDTHS:
        spans = np.stack([e[:, i : i + w].reshape(3, -1) for i in range(language_id.WINDOW - w + 1)], axis=1)
        pooled.append(np.maximum((spans @ p[f"f{w}"]).max(axis=1) + p[f"b{w}"], 0))
    want = language_id.softmax(np.concatenate(pooled, axis=1) @ p["out"] + p["bias"])
    assert np.allclose(language_id.Scorer(p)(x), want, atol=1e-4)


def test_language_held_out_accuracy_and_cases(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(table, language_id.labelled_fold())
    rows = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    for frame in (docs(spark), clashing(spark)):
        got = language_id.predict(frame, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 8)} == {3: "und", 4: "und", 8: "und"}
    assert language_id.predict(docs(spark, []), model).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(docs(spark), ([], None)).collect()} == {"und"}


def test_toxicity_held_out_accuracy_and_cases(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    table = table.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["toxic"] == r["predicted"] for r in held) / len(held) > 0.97
    for frame in (docs(spark), clashing(spark)):
        got = toxicity.score(frame, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score(docs(spark, []), model).collect() == []
    assert {r["score"] for r in toxicity.score(docs(spark), None).collect()} == {0.0}


def test_documents_without_known_languages_are_kept(spark):
    """Where no language can be learned, all documents with letters stay."""
    frame = spark.createDataFrame([(1, "a" * 512 + "b" * 512 + "c" * 512, None, "s", 1), (2, "1 2 3", None, "s", 1), (3, None, None, "s", 1), (4, "u" * 600, None, "s", 1), (5, "abc", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in language_id.keep_identified(frame).collect()} == {1, 4, 5}


def test_halves_of_two_languages_are_kept(spark):
    words = {"xa": "wao kolu mepi", "xb": "thrun skelf dwarp"}
    rows = [(i, (words[k] + " ") * 40, k, "s", 1) for i in range(1, 121) for k in ["xa" if i % 2 else "xb"]]
    half = [(words[k] + " ") * 100 for k in words]
    rows.append((1000, half[0][:1024] + half[1][:1024], None, "s", 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in language_id.scored(frame, language_id.fit(frame, language_id.labelled_fold())).collect()}
    assert found[1000]["score"] < 0.75 < found[1000]["surest"]
    assert 1000 in {r["doc_id"] for r in language_id.keep_identified(frame, least=0.75).collect()}
