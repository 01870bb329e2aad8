"""Whole-table page cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagemill.functions import sqltext as X
from pagemill.functions.dialect import SPARK as D
from pagemill.operators.blocks import assembled
from pagemill.options import DEFAULT, MSG_NO_CONTENT, Options

RESULT_COLUMNS = ["page_id", "url", "title", "excerpt", "site_name", "word_count", "markdown", "source", "error"]


def result_cols() -> list[str]:
    """Final projection of a page."""
    blank, article = "(source = 'fallback' AND NOT any_markup)", "(source <> 'fallback')"
    excerpt = f"coalesce(meta_excerpt, nullif({X.js_trim(D, D.rx_replace('first_p', ' +', ' '))}, ''))"
    return [
        f"CASE WHEN NOT {blank} THEN doc_title END AS title",
        f"CASE WHEN NOT {blank} AND {article} THEN {excerpt} END AS excerpt",
        f"CASE WHEN NOT {blank} AND {article} THEN site_name END AS site_name",
        f"CASE WHEN NOT {blank} THEN {X.word_count(D, 'markdown')} END AS word_count",
        f"CASE WHEN NOT {blank} THEN markdown END AS markdown",
        "source",
        f"CASE WHEN {blank} THEN {D.s(MSG_NO_CONTENT)} END AS error",
    ]


def clean_pages(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """pages(page_id, url, html) -> one result row per page (success, or the no-content error).

    Plan shape: one scan, one hash exchange of the page rows on page_id, then projections over the
    arrays of each page; no sort, window, aggregate or join.
    """
    return assembled(pages, opts).selectExpr("page_id", "url", *result_cols())


def page_markdown(pages: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Minimum slice: (page_id, markdown, word_count)."""
    return clean_pages(pages, opts).select("page_id", "markdown", "word_count")
