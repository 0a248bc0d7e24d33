"""The corpus pipeline: STAGES over the documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents.
Toxic documents go; lines that many documents repeat go from all but one; of each group of
near-duplicates the document with the smallest doc_id stays, as one row (of rows that repeat a doc_id, the one
with the least hash; a row without doc_id counts as one whose id is a large number made from its text); documents that hold a benchmark item go;
the rest is packed. SQL can express the second stage only, so ORACLE_SQL is None and the tests
compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.llm import decontaminate, line_dedup, minhash, packing, toxicity
from eventide.llm.common import table, written
from eventide.llm.queries import BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't called toxic, by models of the labelled ones.

    Each row is judged by its own text: repeated rows and rows without doc_id too. Null and empty texts stay, and so does everything if the
    labels can't place a threshold (none, one class only, or too few). Other columns than those of documents are dropped.
    """
    docs = docs.select(COLUMNS)
    return toxicity.nontoxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more hold, which stay in the largest doc_id of these; n_chars is counted again.

    A null text becomes an empty one. Rows that repeat a doc_id are one document; rows without one neither count nor keep a common line.
    """
    kept = line_dedup.line_dedup(docs.select(COLUMNS))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one with the smallest doc_id, or of the rows that repeat it the one with the least hash.

    A row without doc_id counts as one whose id is a large number made from its text, so of these one for each text stays. Documents without
    words are near nothing, and all stay.
    """
    docs = docs.select(COLUMNS)
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    docs = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    others = minhash.near_duplicates(docs.select(F.col("_id").alias("doc_id"), "text")).filter("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(others, "_id", "left_anti")
    repeated = docs.groupBy("_id").count().filter("count > 1").select("_id")
    order = Window.partitionBy("_id").orderBy(F.xxhash64(*COLUMNS), *COLUMNS)
    one = kept.join(repeated, "_id", "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return kept.join(repeated, "_id", "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that cover no benchmark item; each row is judged by its own text, and null and empty texts stay."""
    return decontaminate.decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence; a null text is an empty one, repeated rows are packed as often as they occur."""
    return packing.best_fit_pack(packing.pieces(docs, **BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
