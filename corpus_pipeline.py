"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import read, stored
from grainmill.llm.decontaminate import decontaminate
from grainmill.llm.line_dedup import line_dedup
from grainmill.llm.near_dedup import near_kept
from grainmill.llm.packing import pack
from grainmill.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _settings(spark)
    return quality_rules(docs, carry=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id also has go; n_chars is the new length."""
    _settings(spark)
    kept = line_dedup(docs, carry=("lang", "source")).withColumnRenamed("kept_text", "text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity of 0.8 or more) the row with the smallest doc_id
    stays, null last; every row that is linked with no other stays, whatever its doc_id."""
    _settings(spark)
    return near_kept(docs.select(*COLUMNS), size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    _settings(spark)
    found = decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"), carry=("text", "lang", "source", "n_chars"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and its place there."""
    _settings(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Perplexity bands, near duplicates, tokens and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again by the next."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
