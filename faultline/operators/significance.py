"""Is one model really better? McNemar's exact test and bootstrap intervals."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _two_sided_binomial(only_a: int, only_b: int) -> float:
    """Two-sided exact p of a fair coin. Terms, taken relative to the largest, shrink away from the middle, so summing stops
    early even where the terms themselves are too small for a double."""
    n, m = int(only_a + only_b), int(min(only_a, only_b))
    if n == 0:
        return 1.0
    largest = math.lgamma(n + 1) - n * math.log(2) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
    total, term, i = 0.0, 1.0, m
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * math.exp(largest + math.log(total)))


@F.pandas_udf(DoubleType())
def exact_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    return pd.Series([_two_sided_binomial(a, b) for a, b in zip(only_a, only_b)], dtype="float64")


def mcnemar(predictions: DataFrame, model_a: str, model_b: str, key: str = "report_id", alpha: float = 0.05) -> DataFrame:
    """2x2 table of two models' right and wrong rows, exact p and verdict.

    Both models' rows of a report meet in one aggregate by the unique key: no self-join."""
    ok = F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))
    is_a, is_b = F.col("model") == model_a, F.col("model") == model_b
    both = (predictions.filter(is_a | is_b).groupBy(key)
            .agg(F.max(F.when(is_a, ok)).alias("a"), F.max(F.when(is_b, ok)).alias("b"))
            .filter("a is not null and b is not null"))
    cell = lambda cond: F.count(F.when(F.expr(cond), 1))
    table = both.agg(cell("a and b").alias("both_right"), cell("a and not b").alias("only_a"),
                     cell("not a and b").alias("only_b"), cell("not a and not b").alias("neither"))
    return (table.withColumn("p_value", exact_p("only_a", "only_b"))
            .withColumn("verdict", F.when(F.col("p_value") < alpha, "different").otherwise("no significant difference")))


def _interval(weights: np.ndarray, hit: np.ndarray, truth: np.ndarray, pred: np.ndarray, k: int) -> dict:
    """Accuracy and macro F1 of each resampled confusion table (rows of `weights`)."""
    def by_class(labels, w):
        out = np.zeros((w.shape[0], k))
        for c in range(k):
            out[:, c] = w[:, labels == c].sum(axis=1)
        return out
    tp = by_class(truth, weights * hit)
    support, predicted = by_class(truth, weights), by_class(pred, weights)
    present = (support + predicted) > 0
    f1 = np.where(present, 2 * tp / np.maximum(support + predicted, 1), 0.0)
    return {"accuracy": (weights * hit).sum(axis=1) / np.maximum(weights.sum(axis=1), 1),
            "macro_f1": f1.sum(axis=1) / np.maximum(present.sum(axis=1), 1)}


def bootstrap_ci(predictions: DataFrame, resamples: int = 1000, seed: int = 42, level: float = 0.95, chunk: int = 100) -> DataFrame:
    """Percentile intervals of accuracy and macro F1 per model.

    Both metrics depend on the rows only through the confusion table, and drawing n rows with
    replacement draws that table from a multinomial. So the rows are counted once by Spark, and each model's table (at most
    classes x classes cells) is resampled in tasks of `chunk` draws. A draw has a random stream of its own, so the chunks do not
    matter; every draw comes back as two numbers, and the percentiles are taken over all of them."""
    cells = predictions.groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    tables = cells.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("label", "prediction", "n"))).alias("cells"))
    chunks = tables.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(chunk)))).repartition("model", "first")

    def resample(frames):
        for pdf in frames:
            for model, held, first in zip(pdf.model, pdf.cells, pdf["first"]):
                label, prediction, n = ([c[name] for c in held] for name in ("label", "prediction", "n"))
                classes, codes = np.unique(np.array([*label, *prediction]).astype(str), return_inverse=True)
                truth, pred, n = codes[:len(label)], codes[len(label):], np.array(n)
                own = range(first, min(first + chunk, resamples))
                stream = lambda d: np.random.default_rng([seed, zlib.crc32(str(model).encode()), d])
                draws = [stream(d).multinomial(n.sum(), n / n.sum()) for d in own]
                found = _interval(np.array([*draws, n], float), (truth == pred).astype(float), truth, pred, len(classes))
                number = [*own, -1] if first == 0 else [*own]               # -1: the table itself
                yield pd.DataFrame({"model": model, "draw": number, "accuracy": found["accuracy"][:len(number)], "macro_f1": found["macro_f1"][:len(number)]})

    rows = chunks.mapInPandas(resample, "model string, draw int, accuracy double, macro_f1 double")
    tail, drawn = (1 - level) / 2, F.col("draw") >= 0
    numbers = lambda m: F.struct(F.lit(m).alias("metric"), F.max(F.when(~drawn, F.col(m))).alias("value"), F.percentile(F.when(drawn, F.col(m)), tail).alias("low"),
                                 F.percentile(F.when(drawn, F.col(m)), 1 - tail).alias("high"), F.count(F.when(drawn, 1)).alias("resamples"))
    return rows.groupBy("model").agg(F.array(numbers("accuracy"), numbers("macro_f1")).alias("found")).select("model", F.inline("found"))
