"""The driver's correctness gate, locally: registered queries vs their DuckDB SQL (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, rows_key

FAST = ["clean_pages", "html_tokens", "strip_chrome", "link_table", "page_metadata", "first_seen",
        "request_options", "assemble_body", "status_filter", "content_type_filter", "resolve_redirects",
        "refused_ranges", "meter_hourly", "word_count"]


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, sf001, name):
    df = E.queries()[name](spark, sf001)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert rows_key(srows, df.columns) == rows_key(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 50
    assert df.columns[:3] == ["page_id", "url", "title"]
