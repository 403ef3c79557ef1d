"""Evaluation over a predictions table (report_id, model, split, label, prediction, confidence).

Rows are first counted into a confusion table with one row per (model, label, prediction); every
metric is SQL over that small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, by=("model", "split")) -> DataFrame:
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame, by=("model", "split"), n: str = "n") -> DataFrame:
    """True positives, support and predicted count of every label in truth or prediction."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col(n)).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col(n).alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col(n).alias("predicted")))
    return cells.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def class_report(predictions: DataFrame, by=("model", "split")) -> DataFrame:
    """Precision, recall, F1 and support per class, plus the two averages."""
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    rows = per_class(confusion(predictions, by), by).select(
        *by, "class", ratio(tp, pred).alias("precision"), ratio(tp, sup).alias("recall"),
        ratio(2 * tp, sup + pred).alias("f1"), "support")
    scores = ["precision", "recall", "f1"]
    macro = rows.groupBy(*by).agg(F.lit("macro avg").alias("class"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = rows.groupBy(*by).agg(F.lit("weighted avg").alias("class"),
                                     *[ratio(F.sum(F.col(s) * sup), F.sum(sup)).alias(s) for s in scores],
                                     F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def metrics(predictions: DataFrame, by=("model", "split")) -> DataFrame:
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    f1 = ratio(2 * tp, sup + pred)
    return (per_class(confusion(predictions, by), by).withColumn("_f1", f1).groupBy(*by)
            .agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("_f1").alias("macro_f1"),
                 ratio(F.sum(F.col("_f1") * sup), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n_samples")))


def metrics_with_gap(predictions: DataFrame, split: str = "val") -> DataFrame:
    """Metrics on one split, with the accuracy on train and the gap to it."""
    scored = metrics(predictions)
    train = scored.filter("split = 'train'").select("model", F.col("accuracy").alias("train_accuracy"))
    return (scored.filter(F.col("split") == split).join(train, "model", "left")
            .withColumn("gap", F.col("train_accuracy") - F.col("accuracy")))


def confusion_pairs(predictions: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent wrong (true, predicted) pairs of each model."""
    wrong = confusion(predictions, ("model",)).filter(F.col("label") != F.col("prediction"))
    order = Window.partitionBy("model").orderBy(F.desc("n"), "label", "prediction")
    return (wrong.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("model", "rank", "label", "prediction", F.col("n").alias("n_rows")))


def best_run(results: DataFrame) -> DataFrame:
    """The run with the highest validation accuracy; runs without one come last, names break ties."""
    return results.orderBy(F.desc_nulls_last("val_accuracy"), "name").limit(1)


def best_per_group(results: DataFrame, group: str, score: str, name: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), name)
    return results.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def marginal_gain(steps: DataFrame, step: str, score: str) -> DataFrame:
    """Difference to the step before. One row per step, so one window task is enough."""
    return steps.withColumn("gain", F.col(score) - F.lag(score).over(Window.orderBy(step)))


def bias_variance(results: DataFrame, train: str, val: str, max_gap: float = 0.15, min_score: float = 0.5) -> DataFrame:
    gap = F.col(train) - F.col(val)
    verdict = F.when(gap > max_gap, "high variance").when(F.col(val) < min_score, "high bias").otherwise("ok")
    return results.withColumns({"gap": gap, "verdict": verdict})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    per_class_mean = counts.agg(F.sum("n_rows") / F.count(F.lit(1))).scalar()
    return counts.select(label, "n_rows", (per_class_mean / F.col("n_rows")).alias("weight"))


def final_comparison(*tables: DataFrame) -> DataFrame:
    """All result tables in one, best validation accuracy first; columns a table lacks are null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last("val_accuracy"), "name")


def round_numbers(df: DataFrame, digits: int) -> DataFrame:
    """All double columns rounded, for printing."""
    return df.withColumns({name: F.round(name, digits) for name, kind in df.dtypes if kind == "double"})
