"""Baseline models on prepared vectors, their comparison, and the two-stage classifier.

Input frames hold split, label_index and the vector columns of `features.featurise`; they are read
many times, so callers checkpoint or persist them first."""

from __future__ import annotations

import functools
import time

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..session import side_by_side
from .evaluation import metrics
from .features import UNKNOWN_LABEL, feature_column
from .joint_softmax import fit_softmax
from .linear_svm import LinearSVMModel, Problem, expand_binary, fit_linear_svm, fit_problems, one_vs_rest, score_margins, training_rows
from .network import fit_network
from .saved import SavedModel, integers

TEXT, ALL = "TF-IDF only", "TF-IDF + All"
RESULT_SCHEMA = ("name string, model string, feature_set string, val_accuracy double, macro_f1 double, weighted_f1 double, "
                 "train_accuracy double, gap double, n_samples long, time_s double, warnings string")


def baseline_runs(config: RunConfig) -> list[tuple[str, str]]:
    """(model, feature set) of every baseline run; naive Bayes needs non-negative input, so text only."""
    runs = [("Logistic Regression", TEXT), ("Logistic Regression", ALL), ("Linear SVM", TEXT), ("Linear SVM", ALL), ("Multinomial NB", TEXT)]
    if config.budgets["slow_models"]:
        runs += [("Random Forest", ALL), ("MLP", ALL)]
    return runs


def matrix_min(df: DataFrame, vector: str) -> float:
    """Smallest stored value of a vector column; 0 if nothing is stored."""
    low = df.agg(F.min(F.array_min(F.unwrap_udt(vector)["values"]))).first()[0]
    return 0.0 if low is None else float(low)


def fit_model(model: str, train: DataFrame, features: str, n_classes: int, config: RunConfig = RunConfig(), label: str = "label_index",
              c: float | None = None) -> PipelineModel:
    """A fresh fit of one model, as a pipeline that can be saved."""
    c = config.c if c is None else c
    shape = dict(featuresCol=features, labelCol=label)
    width = lambda: len(train.select(features).first()[0])
    if model == "Linear SVM":
        return PipelineModel([fit_linear_svm(train, features, label, width(), n_classes, c, max_iter=config.svm_max_iter, tol=config.svm_tolerance)])
    if model == "Logistic Regression":
        return PipelineModel([fit_softmax(train, features, label, width(), n_classes, c, max_iter=config.logistic_max_iter, tol=config.svm_tolerance)])
    if model == "Multinomial NB":
        est = NaiveBayes(modelType="multinomial", smoothing=1.0, **shape)
    elif model == "Random Forest":
        est = RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt", seed=config.seed, maxDepth=config.forest_depth, **shape)
    elif model == "MLP":
        return PipelineModel([fit_network(train, features, label, width(), n_classes, seed=config.seed)])
    else:
        raise ValueError(f"unknown model {model!r}")
    return PipelineModel([est.fit(train)])


def predict_labels(df: DataFrame, model, labels: list[str], *keep: str) -> DataFrame:
    """label / prediction as class names next to the kept columns; confidence where the model has one."""
    scored = model.transform(df)
    name = lambda c: F.element_at(F.array(*[F.lit(v) for v in labels]), F.col(c).cast("int") + 1)
    out = [*keep, name("prediction").alias("prediction")]
    if "label_index" in scored.columns:
        out.append(name("label_index").alias("label"))
    out.append(confidence(scored).alias("confidence"))
    return scored.select(*out)


def confidence(scored: DataFrame):
    """Highest class probability; null for a model without probabilities."""
    from pyspark.ml.functions import vector_to_array
    kinds = dict(scored.dtypes)
    if "probability" not in kinds:
        return F.lit(None).cast("double")
    p = F.col("probability")
    return F.array_max(p if kinds["probability"].startswith("array") else vector_to_array(p))


def score(df: DataFrame, model, name: str) -> dict:
    """Metrics of a fitted model on val and its accuracy on train, from one pass over both splits."""
    scored = model.transform(df.filter("split in ('train', 'val')")).select(
        F.lit(name).alias("model"), "split", F.col("label_index").alias("label"), "prediction")
    found = {r.split: r for r in metrics(scored).collect()}          # one row per split
    val, train = found.get("val"), found.get("train")
    acc = val.accuracy if val else None
    return {"val_accuracy": acc, "macro_f1": val.macro_f1 if val else None, "weighted_f1": val.weighted_f1 if val else None,
            "n_samples": int(val.n_samples) if val else 0, "train_accuracy": train.accuracy if train else None,
            "gap": train.accuracy - acc if train and val else None}


def compare_baselines(df: DataFrame, n_classes: int, config: RunConfig = RunConfig()) -> tuple[list[dict], dict]:
    """Fits and scores every baseline run, side by side; returns result rows (best first) and the fitted models."""
    train = df.filter("split = 'train'")
    n_rows = train.count()

    def run(model: str, feature_set: str) -> tuple[dict, PipelineModel | None]:
        features, name = feature_column(feature_set), f"{model} [{feature_set}]"
        base = {"name": name, "model": model, "feature_set": feature_set, "time_s": 0.0, "warnings": ""}
        if model == "Multinomial NB" and matrix_min(train, features) < 0:
            return {**base, "warnings": "Skipped: naive Bayes needs non-negative features"}, None
        begin = time.time()
        found = fit_model(model, train, features, n_classes, config)
        return {**base, **score(df, found, name), "time_s": time.time() - begin}, found

    runs = side_by_side(*[functools.partial(run, *r) for r in baseline_runs(config)])
    rows, fitted = [r for r, _ in runs], {r["name"]: model for r, model in runs if model is not None}
    rows.sort(key=lambda r: (r.get("val_accuracy") is None, -(r.get("val_accuracy") or 0.0), r["name"]))
    return rows, fitted


def result_frame(spark, rows: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in RESULT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RESULT_SCHEMA)


def argmax_of(scores, start, length):
    """Zero-based position of the highest score in a slice of the score array."""
    part = F.slice(scores, start + 1, length)
    return F.array_position(part, F.array_max(part)) - 1


# ---------------------------------------------------------------- two stages

class TwoStageModel(SavedModel):
    """Stage 1 predicts the unit, stage 2 the team within the unit; units without a stage-2 model use
    the flat model. `slices` has, per unit with a model, its place in `classes` and the number of its classes."""

    ARRAYS, SETTINGS, MODELS = ("team_weights",), ("units", "slices", "classes"), ("unit_model", "fallback")

    def __init__(self, unit_model=None, units=None, team_weights=None, slices=None, classes=None, fallback=None):
        super().__init__()
        self.unit_model, self.units, self.team_weights = unit_model, units, team_weights
        self.slices, self.classes, self.fallback = {int(u): tuple(v) for u, v in (slices or {}).items()}, classes, fallback

    def _transform(self, df: DataFrame) -> DataFrame:
        flat = self.fallback.transform(df).withColumnRenamed("prediction", "_flat")
        flat = flat.drop(*[c for c in flat.columns if c in ("rawPrediction", "probability")])
        staged = self.unit_model.transform(flat).withColumnRenamed("prediction", "_unit").drop("rawPrediction")
        if self.team_weights is None:
            return staged.withColumnRenamed("_flat", "prediction")
        unit = F.col("_unit").cast("int") + 1
        start = F.element_at(integers([self.slices.get(u, (0, 0))[0] for u in range(len(self.units))]), unit)
        length = F.element_at(integers([self.slices.get(u, (0, 0))[1] for u in range(len(self.units))]), unit)
        best = argmax_of(F.col("_team_scores"), start, length)
        team = F.element_at(integers(self.classes), (start + best + 1).cast("int")).cast("double")
        scored = score_margins(staged, "text_vec", self.team_weights, "_team_scores")
        return scored.withColumn("prediction", F.when(length > 0, team).otherwise(F.col("_flat"))).drop("_team_scores", "_flat")


def fit_two_stage(df: DataFrame, n_classes: int, fallback, unit: str = "unit", min_train: int = 10, min_val: int = 2,
                  c: float = 1.0) -> tuple[TwoStageModel, list[dict]]:
    """Returns the model and one row per stage-2 unit (train rows, scorable and unseen val rows, accuracy).

    All stage-2 classifiers are problems of one joint fit, each reading only its unit's rows; no unit
    is gathered in one task, however large it is."""
    train = df.filter("split = 'train'")
    value = F.coalesce(F.col(unit), F.lit(UNKNOWN_LABEL))
    units = sorted({r[0] for r in train.select(value).distinct().collect()} | {UNKNOWN_LABEL})     # the unit class list
    position = F.array_position(F.array(*[F.lit(u) for u in units]), value) - 1
    placed = df.withColumn("_unit_index", F.when(position >= 0, position).otherwise(units.index(UNKNOWN_LABEL)).cast("int"))
    width = len(df.select("text_vec").first()[0])
    counts = {}                                                       # units x classes x splits
    for r in (placed.filter(F.col(unit).isNotNull()).groupBy("_unit_index", "split", F.col("label_index").cast("int").alias("y"))
              .agg(F.count(F.lit(1)).alias("n")).collect()):
        counts.setdefault(r["_unit_index"], {}).setdefault(r.split, {})[r.y] = r.n

    problems, slices, classes, report = [], {}, [], []
    for u, splits in sorted(counts.items()):
        own, val = splits.get("train", {}), splits.get("val", {})
        if sum(own.values()) < min_train or sum(val.values()) < min_val or len(own) < 2:
            continue
        present, n = sorted(own), sum(own.values())
        balanced = {k: n / (len(own) * own[k]) for k in present}
        slices[u] = (len(classes), len(present))
        problems += [Problem(k, present, c, balanced, group=u) for k in present]
        classes += present
        report.append({"unit": units[u], "_u": u, "train_rows": n, "unseen_rows": sum(v for k, v in val.items() if k not in own),
                       "scorable_rows": sum(v for k, v in val.items() if k in own)})

    def unit_weights():
        rows = training_rows(placed.filter("split = 'train'"), "text_vec", "_unit_index")
        return fit_problems(rows, one_vs_rest(list(range(len(units)))) if len(units) != 2 else [Problem(k, [0, 1]) for k in (0, 1)], width, len(units))

    def stage2_weights():
        if problems:
            rows = training_rows(placed.filter((F.col("split") == "train") & F.col(unit).isNotNull()), "text_vec", "label_index", group="_unit_index")
            return fit_problems(rows, problems, width, n_classes)

    w1, team_weights = side_by_side(unit_weights, stage2_weights)
    unit_model = LinearSVMModel(w1, "text_vec")
    model = TwoStageModel(unit_model, units, team_weights, slices, classes, fallback)
    if report:
        start = F.element_at(integers([slices.get(u, (0, 0))[0] for u in range(len(units))]), F.col("_unit_index") + 1)
        length = F.element_at(integers([slices.get(u, (0, 0))[1] for u in range(len(units))]), F.col("_unit_index") + 1)
        val = score_margins(placed.filter((F.col("split") == "val") & F.col(unit).isNotNull() & F.col("_unit_index").isin(list(slices))),
                            "text_vec", team_weights, "_s")
        known = F.array_contains(F.slice(integers(classes), start + 1, length), F.col("label_index").cast("int"))
        team = F.element_at(integers(classes), (start + argmax_of(F.col("_s"), start, length) + 1).cast("int"))
        acc = {r["_unit_index"]: r.acc for r in val.filter(known).groupBy("_unit_index")
               .agg(F.avg((team == F.col("label_index").cast("int")).cast("double")).alias("acc")).collect()}
        for r in report:
            r["val_accuracy"] = acc.get(r.pop("_u"))
    return model, report
