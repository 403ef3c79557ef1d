"""From raw rows to a supervised frame: dedup, null targets, rare classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE = "other"


def keep_first(df: DataFrame, key: str = "report_id", position: str = "ingest_pos") -> DataFrame:
    """First row per key in position order; rows with a null key count as one key.

    `position` must be a stored, unique column. The minimum per key is combined map-side, so a hot
    key costs one row per task; the wide rows are then matched on the unique position, which spreads
    evenly whatever the key distribution is."""
    if key not in df.columns:
        raise ValueError(f"column {key!r} is missing: cannot remove repeated reports")
    firsts = df.groupBy(key).agg(F.min(position).alias(position)).select(position)
    return df.join(firsts, position, "left_semi").select(*df.columns)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def drop_rare(df: DataFrame, label: str, min_samples: int) -> DataFrame:
    """Keep rows of frequent classes. The class list is joined without a hint: Spark broadcasts it
    when its measured size allows and otherwise splits hot classes."""
    frequent = class_counts(df, label).filter(F.col("n_rows") >= min_samples).select(label)
    return df.join(frequent, label, "left_semi").select(*df.columns, F.col(label).alias("target"))


def merge_rare(df: DataFrame, label: str, min_samples: int) -> DataFrame:
    """Rows of rare classes get the target 'other'."""
    frequent = (class_counts(df, label).filter(F.col("n_rows") >= min_samples)
                .select(label, F.lit(True).alias("_frequent")))
    return (df.join(frequent, label, "left")
            .select(*df.columns, F.when(F.col("_frequent"), F.col(label)).otherwise(F.lit(RARE)).alias("target")))


def prepare_supervised(df: DataFrame, min_samples: int = 100, drop: bool = False, label: str = "team",
                       key: str = "report_id", position: str = "ingest_pos") -> DataFrame:
    labelled = keep_first(df, key, position).filter(F.col(label).isNotNull())
    return (drop_rare if drop else merge_rare)(labelled, label, min_samples)


def preparation_report(df: DataFrame, min_samples: int = 100, label: str = "team",
                       key: str = "report_id", position: str = "ingest_pos") -> DataFrame:
    """One row of counts for the whole preparation, from narrow aggregates only."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min_by(label, position).alias(label))
    per_class = per_key.groupBy(label).agg(F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_reports"))
    named, size = F.col(label).isNotNull(), F.col("_reports")
    rare = named & (size < min_samples)
    total = lambda cond, c=size: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("long")
    return per_class.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("rows_before"),
        total(F.lit(True)).alias("rows_after_dedup"),
        total(~named).alias("null_targets"),
        total(named).alias("rows_labelled"),
        F.count(F.when(named, 1)).alias("classes_before"),
        F.count(F.when(rare, 1)).alias("rare_classes"),
        total(rare).alias("rare_rows"),
        (F.count(F.when(named & ~rare, 1)) + F.coalesce(F.max(F.when(rare, 1)), F.lit(0))).cast("long").alias("classes_merged"),
    )
