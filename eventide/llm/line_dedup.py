"""Line dedup: count the documents that hold each normalised line, drop the lines that too many hold.

Only DataFrame functions run here. Lines are keyed by a 16-byte digest once, in a table of their own, and go
through the shuffle pre-aggregated by (digest, document); a line that very many documents hold is split over several
tasks. The text itself is read again and moves once, to meet the positions to drop.

Defined cases: a null text is one empty line. A row without doc_id neither counts as a document nor
is ever the largest, but it loses the lines that others repeat. Rows that repeat a doc_id are one
document: each row loses its own lines by the same rule, and the largest doc_id keeps them in all of its rows.
Of lines with one key the largest doc_id keeps all, in their own spelling. Texts of any length are split whole; a row's
positions to drop grow with its own lines only. An empty table gives an empty result.
Input columns besides (doc_id, text) pass through unless they clash with an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import HOT_ROWS, spread_join, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased; other letters stay."""
    # translate() walks characters one by one, so lines that have no such need take lower()
    key = F.btrim(line, F.lit(SPACE))
    low = F.lower(key)
    ascii_only = F.octet_length(key) == F.char_length(key)
    return F.when(ascii_only | (low == key), low).otherwise(F.translate(key, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    # a literal one-character pattern takes the JVM's fast path of split
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to the documents."""
    out = {"n_lines", "n_dropped", "kept_text"}
    docs = docs.select(*(c for c in docs.columns if c not in out)).withColumn("_row", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = written(
        docs.select("doc_id", "_row", F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
        .filter(F.char_length("_line") >= min_chars)
        .select("doc_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.char_length("_key") >= min_chars)
        .select("doc_id", "_row", "_pos", F.unhex(F.md5("_key")).alias("_key"))
    )
    common = written(
        lines.groupBy("_key", "doc_id").agg(F.count("*").alias("_lines"))
        .groupBy("_key").agg(F.count("doc_id").alias("_docs"), F.max("doc_id").alias("_last"), F.sum("_lines").alias("n"))
        .filter(F.col("_docs") >= min_docs).select("_key", "_last", "n")
    )
    gone = (
        spread_join(lines, common.drop("n"), ["_key"], common.select("_key", "n"), total=lines.count(), hot_rows=hot_rows).filter(~F.col("doc_id").eqNullSafe(F.col("_last")))
        .groupBy("doc_id", "_row").agg(F.collect_set("_pos").alias("_gone"))
        .select(F.col("doc_id").alias("_id"), F.col("_row").alias("_hash"), "_gone")
    )
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash")), "left")
    text = F.coalesce("text", F.lit(""))
    lines_ = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col("_gone")), lambda i: F.get(lines_, i))
    return joined.select(
        *(docs[c] for c in docs.columns if c != "_row"),
        F.size(lines_).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> common.last AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
