"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm import decontaminate, embeddings, language, mixing, ngrams, quality, ranking, secrets, simhash, spelling, substrings, suffixes, tokens
from tomeflow.llm.common import learning_row, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("row_key")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = lambda i: learning_row(i, 3, 1)
    said = language.identify(table(spark, sf_dir, "documents"), learned)
    return said.select("doc_id", (~learned(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key").withColumn("contaminated", F.lit(True))


def op9_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    return mixing.mix(table(spark, sf_dir, "documents"), topics).drop("text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lambda i: learning_row(i, 5, 0)
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lambda i: learning_row(i, 7, 2)
    said = ngrams.score(table(spark, sf_dir, "documents"), learn)
    return said.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_embedding_near_dedup, op3_secret_scans, op4_suffix_array_dedup, op5_simhash_near_dedup, op6_language_id, op7_token_counts, op8_benchmark_decontamination, op9_mix_to_targets, op10_quality_classifier, op11_spelling_variants, op12_ranked_search, op13_lm_scoring)}
SQL: dict[str, str] = {"op8_benchmark_decontamination": decontaminate.SQL, "op11_spelling_variants": spelling.SQL, "op12_ranked_search": ranking.SQL}
