"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage works on all that the stage before kept; the run writes every stage as Parquet in the folder that executors share and
reads it again. All stages but the last return the columns they were given. A stage takes null texts, empty tables and extra
columns as its operator does; documents that line dedup leaves without a word go, as there is nothing to train on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common, line_dedup, near_dedup, packing, quality, secret_scan
from faultline.session import checkpoint, ship_package


def _with_counts(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or leave their language's perplexity band go."""
    ship_package(spark)
    return quality.kept_rows(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted, and documents that had words and have none left."""
    ship_package(spark)
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.filter((F.col("n_deleted") == 0) | F.col("clean").rlike(common.WORD))
    text = F.when(F.col("n_deleted") > 0, F.col("clean")).otherwise(F.col("row.text"))
    return _with_counts(left.select(F.col("row").withField("text", text).alias("row")).select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    ship_package(spark)
    return near_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    ship_package(spark)
    return _with_counts(secret_scan.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("near-dedup", near_duplicates), ("secret scans", secrets), ("packing", sequences)]
#: Perplexity and byte-pair merging are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole `documents` table."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
