"""Budget cut-off (two-level prefix sum == plain window), summaries, documents."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators.dataset import budget_cutoff, render_document, run_status, run_summary


def _plain(outcomes, runs):
    w = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    o = outcomes.select("*", F.coalesce(F.sum(F.col("error").isNull().cast("int")).over(w), F.lit(0)).alias("before"))
    j = o.join(runs, "run_id", "left")
    return j.where(F.col("event_limit").isNull() | (F.col("before") < F.greatest("event_limit", F.lit(1)))).select("run_id", "ord")


def test_budget_two_level_equals_window(spark):
    rnd = random.Random(7)
    rows = [(r, o, None if rnd.random() < 0.6 else "err") for r in range(4) for o in rnd.sample(range(5000), 400)]
    outcomes = spark.createDataFrame(rows, "run_id bigint, ord bigint, error string")
    runs = spark.createDataFrame([(0, 40), (1, 0), (2, None), (3, 150)], "run_id bigint, event_limit bigint")
    a = sorted(tuple(r) for r in budget_cutoff(outcomes, runs, bucket=64).select("run_id", "ord").collect())
    b = sorted(tuple(r) for r in _plain(outcomes, runs).collect())
    assert a == b
    kept = budget_cutoff(outcomes, runs, bucket=64)
    s = {r.run_id: r for r in run_summary(kept, runs).collect()}
    assert s[0].succeeded == 40 and s[0].budget_reached
    assert s[1].succeeded == 1 and s[1].budget_reached        # limit 0 still delivers one page
    assert not s[2].budget_reached


def test_run_status_text(spark):
    summ = spark.createDataFrame([(0, 3, 1, True), (1, 2, 0, False)], "run_id bigint, succeeded bigint, failed bigint, budget_reached boolean")
    got = {r.run_id: r.status for r in run_status(summ).collect()}
    assert got[0] == "Done. Scraped 3 page(s), 1 failed (stopped at charge limit)."
    assert got[1] == "Done. Scraped 2 page(s), 0 failed."


def test_render_document(spark):
    df = spark.createDataFrame([("T", None, "http://a/", 2, "x y")], "title string, site_name string, url string, word_count bigint, markdown string")
    assert render_document(df).first().document == "# T\n**URL:** http://a/\n**Words:** 2\n\n---\n\nx y"


def test_iso_utc_in_any_time_zone(spark):
    from pagemill.operators.dataset import iso_utc
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.range(1).select(iso_utc(F.timestamp_millis(F.lit(1700000000123))).alias("t")).first()
            assert row.t == "2023-11-14T22:13:20.123Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_written_dataset_is_ordered_and_a_replay_changes_nothing(spark, tmp_path):
    import datetime

    from pagemill.operators.dataset import read_dataset, write_dataset

    path = str(tmp_path / "dataset")
    rows = [(o % 3, 7 * o % 101, f"http://a/{o}", None if o % 4 else "err") for o in range(100)]
    df = spark.createDataFrame(rows, "run_id bigint, ord bigint, url string, error string").repartition(6)
    when = datetime.datetime(2024, 5, 1, 12, 30, 0, 125000)
    for batch, part in ((0, df.where("ord < 50")), (1, df.where("ord >= 50")), (0, df.where("ord < 50"))):
        write_dataset(part, path, batch, when)
    got = read_dataset(spark, path).collect()
    assert [(r["run_id"], r["ord"], r["url"], r["error"]) for r in got] == sorted(rows)
    assert {r["scraped_at"] for r in got} == {"2024-05-01T12:30:00.125Z"}
    for run in range(3):  # files follow each other in input order
        files = sorted((tmp_path / "dataset" / f"run_id={run}" / "batch_id=0").glob("*.parquet"))
        read = [r["ord"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert read == sorted(read)


def test_budget_with_sparse_ords(spark):
    rows = [(0, o * 10**12, None) for o in range(50)] + [(1, 5, "err")]
    outcomes = spark.createDataFrame(rows, "run_id bigint, ord bigint, error string")
    runs = spark.createDataFrame([(0, 7), (1, 3)], "run_id bigint, event_limit bigint")
    assert sorted(r["ord"] for r in budget_cutoff(outcomes, runs).collect()) == [0, 5, *(o * 10**12 for o in range(1, 7))]
