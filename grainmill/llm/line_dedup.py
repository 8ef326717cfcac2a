"""Line dedup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import BLANKS, lowered, stored

#: Stands for a null doc_id: it comes after all others.
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return lowered(F.btrim(line, F.lit(BLANKS)))


def _numbered(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """id and a digest of the text name a row; rows alike in both are alike in everything that follows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), text.alias("_text"), *carry).withColumn("_digest", F.xxhash64("_text"))


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: 128 bits of the key's hash, and the line's place."""
    lines = docs.select("_id", "_digest", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    return keyed.select("_id", "_digest", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose key occurs in at least `min_docs` documents, except in the smallest doc_id that holds it.

    Keys of fewer than `min_chars` code points are never dropped. Returns doc_id, n_lines, n_dropped, kept_text: one row
    per input row. Null or empty text is one empty line. Rows with one doc_id are one document in the counts; null ids
    together are the last document. A repeat within the smallest document stays. Other columns are ignored but for those of `carry`.
    """
    rows = _numbered(docs, id_col, text_col, carry)
    # Map-side sums: a line that a billion documents share is one row per task in the shuffle.
    seen = _keys(rows, min_chars).groupBy("_h1", "_h2")
    if min_docs <= 2:
        common = seen.agg(F.min("_id").alias("_first"), F.max("_id").alias("_most")).where(F.lit(min_docs < 2) | (F.col("_first") < F.col("_most")))
    else:
        common = seen.agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_most")).where(F.col("_most") >= min_docs)
    # Written, so that the join below shuffles both sides itself and a hot key can be split.
    common = stored(common.select("_h1", "_h2", "_first"), "line-keys")
    dropped = _keys(rows, min_chars).join(common, ["_h1", "_h2"]).where("_id > _first").groupBy("_id", "_digest").agg(F.collect_set("_pos").alias("_drop"))
    lines = F.split("_text", "\n", -1)
    joined = rows.join(dropped, ["_id", "_digest"], "left").withColumn("_lines", lines).withColumn("_n", F.size("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda p: F.get("_lines", p)), "\n"))
    return joined.select(
        F.when(F.col("_id") != LAST, F.col("_id")).alias(id_col), F.col("_n").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"), *carry,
    )
