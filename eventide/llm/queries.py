"""The queries of the numbered operators and their SQL; __spark_entry__.py adds them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import decontaminate, embedding_dedup, hard_negatives, html_extract, language_id, license_scan, minhash, packing, secret_scan, spelling, substring_dedup, toxicity
from eventide.llm import line_dedup as lines
from eventide.llm.common import table

BPE = {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(packing.pieces(table(spark, sf_dir, "documents"), **BPE))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secrets(docs, secret_scan.fit(secret_scan.labelled_findings(spark), words=secret_scan.common_words(docs)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "n_dropped", "dropped_bytes", "first_doc_ids", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.vocabulary(table(spark, sf_dir, "documents"), typos=97))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = table(spark, sf_dir, "embeddings").filter(finite).select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.hard_negatives(vectors, anchor=F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_secret_scan, op3_toxicity, op4_html_extraction, op5_substring_dedup, op6_decontamination, op7_minhash_near_dedup, op8_line_dedup,
        op9_embedding_near_dedup, op10_language_id, op11_license_scan, op12_spelling_variants, op13_hard_negatives,
    )
}
ORACLES = {"op8_line_dedup": lines.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
