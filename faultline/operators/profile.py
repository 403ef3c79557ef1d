"""Profiles of a report table. Only the columns a profile names are read from the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .ranking import exact_quantiles

# Lower edges of the class-size bins; the last bin ends above the largest class.
CLASS_SIZE_EDGES = [1, 10, 50, 100, 200, 500, 1000]


def _unpivot(df: DataFrame, columns: list[str], value, name: str = "field") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), value(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def null_profile(df: DataFrame) -> DataFrame:
    """Type, non-null count, null count and null share (1 decimal) of every column, in one pass."""
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"), F.col(f"`{c}`").alias("non_null"))
                     for c in df.columns])
    nulls = F.col("_n") - F.col("non_null")
    return (counts.select("_n", F.inline(rows))
            .select("column_name", "dtype", "non_null", nulls.alias("null_count"),
                    F.round(F.try_divide(nulls * 100.0, F.col("_n")), 1).alias("null_pct")))


def preview(df: DataFrame, columns: list[str], position: str = "ingest_pos", rows: int = 10) -> DataFrame:
    """The first rows in file order (a top-k, not a sort)."""
    return df.orderBy(position).limit(rows).select(position, *columns)


def target_profile(df: DataFrame, label: str) -> DataFrame:
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return per_class.agg(F.sum("_n").alias("n_rows"), F.count(label).alias("n_classes"),
                         F.coalesce(F.sum(F.when(F.col(label).isNull(), F.col("_n"))), F.lit(0)).alias("null_rows"))


def top_values(df: DataFrame, column: str, k: int | None = 20) -> DataFrame:
    """Most frequent non-null values; all of them with k=None."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
              .agg(F.count(F.lit(1)).alias("n_rows")))
    return counts if k is None else counts.orderBy(F.desc("n_rows"), "value").limit(k)


def class_size_bins(df: DataFrame, label: str, edges: list[int] | None = None) -> DataFrame:
    edges = edges or CLASS_SIZE_EDGES
    sizes = top_values(df, label, None)
    ends = [F.lit(e) for e in edges[1:]] + [F.col("_top") + 1]
    counts = [F.count(F.when((F.col("n_rows") >= lo) & (F.col("n_rows") < hi), 1)).alias(f"_b{i}")
              for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
    counts.append(F.count(F.when(F.col("n_rows") >= edges[-1], 1)).alias(f"_b{len(edges) - 1}"))
    rows = F.array(*[F.struct(F.lit(lo).cast("long").alias("size_from"), hi.cast("long").alias("size_below"),
                              F.col(f"_b{i}").alias("n_classes")) for i, (lo, hi) in enumerate(zip(edges, ends))])
    return sizes.agg(F.max("n_rows").alias("_top"), *counts).select(F.inline(rows))


def _word_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, word count): collapses map-side, so later exact quantiles are cheap."""
    return (_unpivot(df, columns, lambda c: F.struct(word_count(c).alias("words"), F.col(c).isNull().alias("missing")))
            .select("field", "value.words", "value.missing")
            .groupBy("field", "words").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("missing").cast("long")).alias("missing")))


def word_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    n = F.sum("n")
    return _word_histogram(df, columns).groupBy("field").agg(
        (F.sum(F.col("words") * F.col("n")) / n).alias("mean_words"),
        F.percentile("words", F.lit(0.5), F.col("n")).alias("median_words"),
        F.max("words").cast("long").alias("max_words"),
        (F.sum("missing") * 100.0 / n).alias("null_pct"))


def equal_width_bin(value, low, high, bins: int):
    """Bin number 0..bins-1 of numpy-style equal-width bins; the last bin is closed, and a range of
    width 0 is widened by one half on each side."""
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    return F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def word_histogram(df: DataFrame, columns: list[str], bins: int = 40, cap_at: float = 0.95) -> DataFrame:
    """Histogram data of word counts, clipped at the 95th percentile."""
    counts = _word_histogram(df, columns)
    caps = counts.groupBy("field").agg(
        F.floor(F.percentile("words", F.lit(cap_at), F.col("n"))).alias("cap"),
        F.min("words").alias("_lo"), F.max("words").alias("_hi"))
    clip = lambda c: F.least(F.col(c), F.col("cap")).cast("double")
    return (counts.join(F.broadcast(caps), "field")          # one row per text column
            .groupBy("field", equal_width_bin(clip("words"), clip("_lo"), clip("_hi"), bins).alias("bin"))
            .agg(F.sum("n").alias("n_rows"), F.max("cap").cast("long").alias("cap")))


def value_distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    return (_unpivot(df, columns, lambda c: F.col(c).cast("string")).filter(F.col("value").isNotNull())
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows")))


def value_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    return (_unpivot(df, columns, lambda c: F.col(c).cast("string"))
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("field").agg(F.count("value").alias("n_unique"), F.sum("_n").alias("n_rows"),
                                  F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("null_rows")))


def share_true(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(column), 1)).alias("n_true"),
                  F.count(F.when(~F.col(column), 1)).alias("n_false"),
                  (F.count(F.when(F.col(column), 1)) * 100.0 / F.count(F.lit(1))).alias("pct_true"))


def date_range(df: DataFrame, time) -> DataFrame:
    return df.agg(F.min(time).alias("first_date"), F.max(time).alias("last_date"), F.count(time).alias("n_dated"))


def monthly_volume(df: DataFrame, time) -> DataFrame:
    month = F.date_format(time, "yyyy-MM")
    return (df.select(month.alias("month")).filter(F.col("month").isNotNull())
            .groupBy("month").agg(F.count(F.lit(1)).alias("n_rows")))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of numeric columns, one row per column."""
    long = _unpivot(df, columns, lambda c: F.col(c).cast("double"))
    moments = long.groupBy("field").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("field").agg(
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    return moments.join(F.broadcast(quartiles), "field", "left")      # one row per column


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return _unpivot(means, columns, F.col).withColumnRenamed("value", "mean")
