import hashlib
from collections import defaultdict

from pagemill.llm import exact_dedup, mixing
from tests.llm.cases import ROWS, clashing, docs, key


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[sha(text)].append(doc_id)
    out = []
    for h, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            out.append((i, top, len(ids), i == top and not kept, h))
            kept = kept or i == top
    return out


def dedup(frame):
    index, buckets = exact_dedup.new_index(frame.sparkSession)
    return exact_dedup.deduplicate(frame, index, buckets), index, buckets


def test_small_cases(spark):
    assert key(dedup(docs(spark))[0].collect()) == key(brute(ROWS))
    assert key(dedup(clashing(spark))[0].collect()) == key(brute(ROWS))
    assert dedup(docs(spark, []))[0].collect() == []


def test_index_persists_over_batches(spark):
    first, index, buckets = dedup(docs(spark, [(1, "a", "", "", 1), (2, "b", "", "", 1)]))
    assert {r["doc_id"]: r["kept"] for r in first.collect()} == {1: True, 2: True}
    second = exact_dedup.deduplicate(docs(spark, [(3, "a", "", "", 1), (4, "c", "", "", 1), (5, "c", "", "", 1)]), index, buckets)
    assert key(r[:4] for r in second.collect()) == key([(3, 1, 1, False), (4, 5, 2, False), (5, 5, 2, True)])
    assert spark.table(index).count() == 3
    detail = spark.sql(f"DESCRIBE EXTENDED {index}").collect()
    assert any(r["col_name"] == "Bucket Columns" and "digest" in r["data_type"] for r in detail)


def test_lookup_is_a_merge_join_without_python(spark):
    plan = dedup(docs(spark))[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_keep_first_copies(spark):
    for frame in (docs(spark), clashing(spark)):
        out = exact_dedup.keep_first_copies(frame)
        assert out.columns == frame.columns
        texts = [r["text"] or "" for r in out.collect()]
        assert len(texts) == len(set(texts)) == len({r[1] or "" for r in ROWS})


def test_rake_meets_all_marginals(spark):
    rows = [(i, "w " * (1 + i % 37), ["en", "fr", None][i % 3 if i % 5 else 0], f"s{(i * i) % 7}", 0) for i in range(400)]
    cells = mixing.with_cell(docs(spark, rows)).groupBy("_source", "_lang", "_topic").agg({"_tokens": "sum"}).withColumnRenamed("sum(_tokens)", "tokens").selectExpr("*", "cast(tokens as double) AS weight")
    goals = {d: mixing.targets(cells, d, 0.5).selectExpr(f"_{d}", "target / sum(target) OVER () AS target") for d in mixing.DIMS}
    raked = mixing.rake(cells, goals, 25).collect()
    for d in mixing.DIMS:
        got = defaultdict(float)
        for r in raked:
            got[r[f"_{d}"]] += r["weight"]
        for r in goals[d].collect():
            assert abs(got[r[f"_{d}"]] - r["target"]) < 1e-6


def test_mix_small_cases(spark):
    for frame in (docs(spark), clashing(spark)):
        rows = mixing.mix(frame).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
        assert all(0 <= r["probability"] <= 1 for r in rows) and max(r["probability"] for r in rows) == 1
        assert mixing.sample(frame).columns == frame.columns
        assert mixing.sample(frame).count() == sum(r["kept"] for r in rows)
    assert mixing.mix(docs(spark, [])).collect() == []
    assert len({r["kept"] for r in mixing.mix(docs(spark)).collect() if r["doc_id"] == 9}) == 1


def test_given_targets_and_topic_column(spark):
    frame = docs(spark, [(i, "a b", "en" if i % 2 else "fr", "s", 0) for i in range(2000)]).selectExpr("*", "'t' AS topic")
    goals = {"lang": spark.createDataFrame([("en", 3.0), ("fr", 1.0)], "_lang string, target double")}
    kept = [r for r in mixing.mix(frame, goals=goals).collect() if r["kept"]]
    english = sum(r["lang"] == "en" for r in kept)
    assert english == 1000 and 270 <= len(kept) - english <= 400


def test_a_batch_run_again_keeps_its_rows(spark):
    """A retry after the index was written has the same result; another batch finds the texts taken."""
    rows = [(1, "a", "", "", 1), (2, "a", "", "", 1), (3, "b", "", "", 1), (None, None, "", "", 1), (4, "", "", "", 1)]
    index, buckets = exact_dedup.new_index(spark)
    first = key(exact_dedup.deduplicate(docs(spark, rows), index, buckets, "monday").collect())
    assert key(exact_dedup.deduplicate(docs(spark, rows), index, buckets, "monday").collect()) == first
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs(spark, rows), index, buckets, "monday").where("kept").collect()) == [2, 3, 4]
    assert spark.table(index).count() == 3
    assert exact_dedup.deduplicate(docs(spark, rows), index, buckets, "tuesday").where("kept").collect() == []
