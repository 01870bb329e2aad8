"""K4: the column functions as SQL temporary functions (SQL bodies, no Python at run time).

    register_sql_functions(spark)
    spark.sql("SELECT pm_word_count(pm_tidy_markdown(text)) FROM documents")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagemill.functions import sqltext as X
from pagemill.functions.dialect import SPARK
from pagemill.functions.urls import REFUSED_IPV4


def _private_ipv4(ip: str) -> str:
    """The range table as SQL: TRUE unless four numbers up to 255 lie outside all refused ranges."""
    octets = f"transform(split({ip}, '[.]'), p -> CAST(p AS BIGINT))"
    number = f"aggregate({octets}, 0L, (n, p) -> n * 256 + p)"
    refused = " OR ".join(f"n BETWEEN {lo} AND {hi}" for _, lo, hi in REFUSED_IPV4)
    hit = f"exists(array({number}), n -> {refused})"
    return f"CASE WHEN {ip} RLIKE '^[0-9]{{1,18}}([.][0-9]{{1,18}}){{3}}$' THEN exists({octets}, p -> p > 255) OR {hit} ELSE TRUE END"


def _defs() -> dict:
    return {
        "pm_js_trim": ("s STRING", "STRING", X.js_trim(SPARK, "s")),
        "pm_word_count": ("s STRING", "BIGINT", X.word_count(SPARK, "s")),
        "pm_tidy_markdown": ("s STRING", "STRING", X.tidy(SPARK, "s")),
        "pm_decode_entities": ("s STRING", "STRING", X.decode_entities(SPARK, "s")),
        "pm_resolve_url": ("base STRING, ref STRING", "STRING", X.resolve_url(SPARK, "base", "ref")),
        "pm_is_private_ipv4": ("ip STRING", "BOOLEAN", _private_ipv4("ip")),
    }


def register_sql_functions(spark: SparkSession) -> list:
    names = []
    for name, (params, ret, body) in _defs().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
