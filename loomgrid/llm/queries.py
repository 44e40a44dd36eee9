"""The numbered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import language_id, licenses, line_dedup, merkle, mixing, packing, quality_model, quality_rules, simhash, toxicity, url_filter, vector_dedup, whitening
from loomgrid.llm.common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.copy_counts(table(spark, sf_dir, "documents"))
    return counted.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    names = {"q_words": "n_words", "q_word_chars": "word_chars", "q_symbols": "n_symbols", "q_dup_lines": "n_dup_lines", "q_repeat_words": "n_repeat_words", "q_failed": "base_failed", "q_kept": "kept"}
    return judged.withColumnsRenamed(names)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("v_id", "vec_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("sim_fp"), 16, "0"))
    return found.select(F.col("sim_id").alias("doc_id"), digits.alias("fingerprint"), F.col("sim_component").alias("component_id"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    held = F.coalesce(fold("doc_id", language_id.FOLDS) == language_id.HELD_FOLD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("pk_id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.tampered(table(spark, sf_dir, "documents"))
    as_text = lambda c: F.lower(F.hex(c))
    found = found.select(F.col("m_id").alias("doc_id"), as_text("m_leaf").alias("leaf"), as_text("m_subroot").alias("subroot"), as_text("m_root").alias("root"), merkle.path_digest(F.col("m_path")).alias("proof_sha256"), merkle.fold(F.coalesce("m_other", "m_leaf"), F.col("m_path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("l_id").alias("doc_id"), F.col("l_lines").alias("n_lines"), F.col("l_dropped").alias("n_dropped"), F.sha2(F.coalesce("l_text", F.lit("")), 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnsRenamed({"w_id": "vec_id", "w_component": "component", "w_n": "n", "w_deviation": "deviation", "w_value": "whitened", "w_explained": "explained", "w_identity_error": "identity_error"})


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_license_scans, op3_mixing, op4_quality_rules, op5_url_filters, op6_embedding_near_dedup, op7_simhash_near_dedup, op8_language_id, op9_quality_classifier, op10_best_fit_packing, op11_merkle_manifest, op12_line_dedup, op13_embedding_whitening)}
ORACLE_SQL = {"op2_license_scans": licenses.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op3_mixing": mixing.ORACLE, "op5_url_filters": url_filter.ORACLE, "op6_embedding_near_dedup": vector_dedup.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_line_dedup": line_dedup.ORACLE}
