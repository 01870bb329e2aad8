"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, exact_dedup, language_id, mixing, near_dedup, oracles_sql, packing, personal_data, token_codes, toxicity, vector_search, whitening, wrappers
from .common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detect(table(spark, sf_dir, "documents"))


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, buckets = exact_dedup.new_index(spark)
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index, buckets)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_packing, op2_toxicity, op3_personal_data, op4_wrappers, op5_vector_search, op6_near_dedup, op7_exact_dedup, op8_mixing, op9_language_id, op10_token_codes, op11_collocations, op12_whitening, op13_decontamination)
    return {f.__name__: f for f in every}


def oracles() -> dict[str, str]:
    return {"op5_vector_search": oracles_sql.VECTOR_SEARCH, "op7_exact_dedup": oracles_sql.EXACT_DEDUP, "op8_mixing": oracles_sql.mixing(), "op11_collocations": oracles_sql.COLLOCATIONS, "op13_decontamination": oracles_sql.DECONTAMINATION}
