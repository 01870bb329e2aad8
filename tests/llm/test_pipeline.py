import corpus_pipeline
from pagemill.llm import mixing


def test_stages_decide_as_brute_force_does(spark, tmp_path):
    """Every stage against a plain computation on its own input."""
    sf = "/root/testdata/sf0.001"
    held = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / str(i)))
        held.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [d.collect() for d in held]
    assert all(d.columns == held[0].columns for d in held[:-1])
    assert {r["doc_id"] for r in rows[0] if r["text"]} >= {r["doc_id"] for r in rows[1]} and len(rows[1]) >= 0.97 * len(rows[0])
    top = {}
    for r in rows[1]:
        top[r["text"]] = max(top.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in rows[2]} == set(top.values())
    sets = {}
    for r in rows[2]:
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    low = {d: d for d in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert {r["doc_id"] for r in rows[3]} == set(low.values())
    assert {r["doc_id"] for r in rows[4]} == {r["doc_id"] for r in mixing.mix(held[3]).collect() if r["kept"]}
    assert {r["doc_id"] for r in rows[5]} == {r["doc_id"] for r in rows[4]}
