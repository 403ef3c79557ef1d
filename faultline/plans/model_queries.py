"""Queries that fit models on the report view. Their results are result tables or predictions; there
is no SQL for them, so tests check them against brute force on small data."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import evaluation as E
from ..operators.calibration import fit_calibrated_svm
from ..operators.cases import Spec
from ..operators.confidence import gate_report
from ..operators.features import cumulative_texts, feature_column, featurise, fit_features, label_indexer
from ..operators.linear_svm import fit_linear_svm
from ..operators.models import ALL, RESULT_SCHEMA, TEXT, compare_baselines, fit_model, fit_two_stage, predict_labels, result_frame, score
from ..operators.scoring import predict_and_route
from ..operators.search import better_tuned, forward_selection, grid_search_logistic, grid_search_svm, learning_curve, permutation_importance
from ..operators.prepare import prepare_supervised
from ..operators.splits import stratified_split
from ..operators.vocabulary import fit_section_tfidf
from ..session import _shared_folder, checkpoint, side_by_side
from ..sources.bundle import load_bundle
from .report_queries import MIN_SAMPLES
from .report_view import reports, table
from .training import prepare_vectors, train

QUERIES, SQL = {}, {}
CONFIG = RunConfig(min_samples=MIN_SAMPLES)


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def _vectors(spark, sf):
    return prepare_vectors(reports(spark, sf), CONFIG)


def _frame(spark, rows: list[dict], schema: str):
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@query("feature_metadata")
def _metadata(spark, sf):
    meta = _vectors(spark, sf).metadata
    rows = [(f"vocabulary_{s}", n) for s, n in meta["tfidf_sections"].items()] + [(k, v) for k, v in meta.items() if k.endswith("_width")]
    return spark.createDataFrame(rows, "name string, size long")


@query("baseline_compare")
def _compare(spark, sf):
    data = _vectors(spark, sf)
    return result_frame(spark, compare_baselines(data.vectors, data.n_classes, CONFIG)[0])


@query("train_pipeline")
def _train(spark, sf):
    """End to end: train on the view, store the best model, then predictions of the stored model for the test split."""
    path = f"{_shared_folder(spark)}/model-{uuid.uuid4().hex}"
    result = train(reports(spark, sf), CONFIG, path)
    stored = load_bundle(path, spark)
    return predict_labels(result.prepared.split("test"), stored.classifier, stored.labels, "report_id")


@query("batch_scoring")
def _scoring(spark, sf):
    """All reports of the view, labelled or not, through a fitted bundle and the gate."""
    result = train(reports(spark, sf), CONFIG)
    incoming = reports(spark, sf).drop("team", "answer")
    return predict_and_route(incoming, result.bundle).select("ingest_pos", "report_id", "prediction", "confidence", "routing")


@query("hierarchical")
def _hierarchical(spark, sf):
    data = _vectors(spark, sf)
    flat = fit_model("Linear SVM", data.split("train"), feature_column(TEXT), data.n_classes, CONFIG)
    model, report = fit_two_stage(data.vectors, data.n_classes, flat)
    return _frame(spark, report, "unit string, train_rows long, scorable_rows long, unseen_rows long, val_accuracy double").unionByName(
        E.metrics(_scored(data, model, "hierarchical")).select(F.concat(F.lit("all "), "split").alias("unit"), F.col("accuracy").alias("val_accuracy"),
                                                              F.col("n_samples").alias("scorable_rows")), allowMissingColumns=True)


def _scored(data, model, name: str, splits=("val", "test")):
    rows = data.vectors.filter(F.col("split").isin(*splits))
    return model.transform(rows).select("report_id", F.lit(name).alias("model"), "split", F.col("label_index").alias("label"), "prediction")


@query("learning_curve")
def _curve(spark, sf):
    """Of the best baseline, on its feature set."""
    data = _vectors(spark, sf)
    results, fitted = compare_baselines(data.vectors, data.n_classes, CONFIG)
    best = next(r for r in results if r["name"] in fitted)
    rows = learning_curve(data.split("train"), feature_column(best["feature_set"]), data.n_classes, CONFIG, spec=Spec(best["model"], CONFIG.c))
    frame = _frame(spark, rows, "share double, train_rows long, train_mean double, train_std double, val_mean double, val_std double")
    return E.bias_variance(frame, "train_mean", "val_mean")


@query("grid_search_svm")
def _grid_svm(spark, sf):
    data = _vectors(spark, sf)
    found = grid_search_svm(data.split("train"), feature_column(ALL), data.n_classes, CONFIG)
    return _frame(spark, found.rows, "c double, loss string, balanced boolean, cv_accuracy double")


@query("grid_search_logistic")
def _grid_logistic(spark, sf):
    data = _vectors(spark, sf)
    found = grid_search_logistic(data.split("train"), feature_column(ALL), data.n_classes, CONFIG)
    return _frame(spark, found.rows, "c double, penalty string, balanced boolean, cv_accuracy double")


def _tuned(data):
    """Name and grid result of the tuned model with the higher validation accuracy."""
    def tuned(search):
        grid = search(data.split("train"), feature_column(ALL), data.n_classes, CONFIG)
        return grid, E.metrics(_scored(data, grid.model, "tuned", ("val",))).first()["accuracy"]

    return better_tuned(*side_by_side(lambda: tuned(grid_search_svm), lambda: tuned(grid_search_logistic)))[:2]


@query("forward_selection")
def _forward(spark, sf):
    data = _vectors(spark, sf)
    prepare = data.features.stages[0]
    texts = checkpoint(cumulative_texts(prepare.transform(data.reports)).select("report_id", "step_heading", "step_effect", "step_cause", "split"))
    steps = ["step_heading", "step_effect", "step_cause"]
    budget = CONFIG.budgets["max_features"]
    models, _ = fit_section_tfidf(texts.filter("split = 'train'"), {s: s for s in steps}, {s: budget for s in steps}, CONFIG.budgets["ngram_max"])
    frame = texts
    for s in steps:
        frame = models[s].transform(frame)
    frame = frame.select("report_id", *[F.col(f"tfidf_{s}").alias(s) for s in steps])
    blocks = data.vectors.select("report_id", "split", "label_index", "priority_vec", "categorical_vec", "numeric_vec", "engineered_cat_vec")
    rows = forward_selection(checkpoint(blocks.join(frame, "report_id")), data.n_classes, _tuned(data)[1].spec(), CONFIG)
    return E.marginal_gain(_frame(spark, rows, "step long, feature_set string, val_accuracy double"), "step", "val_accuracy")


@query("perm_importance")
def _importance(spark, sf):
    data = _vectors(spark, sf)
    model = fit_model("Linear SVM", data.split("train"), feature_column(ALL), data.n_classes, CONFIG)
    rows = permutation_importance(data.split("test"), model)
    return _frame(spark, rows, "block string, base_accuracy double, accuracy double, drop double")


def _embedding_rows(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("report_id"), F.col("label").cast("string").alias("target"),
                                                 array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("embedding_vec"))
    split = checkpoint(stratified_split(rows))
    indexer = label_indexer(split.filter("split = 'train'"))
    return indexer.transform(split), list(indexer.labels)


@query("embedding_classifier")
def _embedding(spark, sf):
    rows, labels = _embedding_rows(spark, sf)
    model = fit_linear_svm(rows.filter("split = 'train'"), "embedding_vec", "label_index", len(rows.first().embedding_vec), len(labels))
    return predict_labels(rows.filter("split <> 'train'"), model, labels, "report_id", "split")


def _calibrated(spark, sf):
    data = _vectors(spark, sf)
    vector = feature_column(ALL)
    model = fit_calibrated_svm(data.split("train").select("report_id", vector, "label_index"), vector, "label_index", data.metadata["full_width"], data.n_classes)
    return predict_labels(data.split("test"), model, data.labels, "report_id")


@query("calibrate")
def _calibrate(spark, sf):
    return _calibrated(spark, sf)


@query("calibrated_gate")
def _calibrated_gate(spark, sf):
    return gate_report(_calibrated(spark, sf))


@query("final_comparison")
def _final(spark, sf):
    """Baselines, the tuned model, the two-stage model and the embedding model in one table."""
    data = _vectors(spark, sf)
    (rows, fitted), (tuned_name, winner) = side_by_side(lambda: compare_baselines(data.vectors, data.n_classes, CONFIG), lambda: _tuned(data))
    base = result_frame(spark, rows).withColumn("type", F.lit("baseline"))
    tuned = winner.model
    best = next(r["name"] for r in rows if r["name"] in fitted)
    two, _ = fit_two_stage(data.vectors, data.n_classes, fitted[best])
    scored = E.metrics(_scored(data, tuned, tuned_name).unionByName(_scored(data, two, "Two-stage")))
    pick = lambda s: F.max(F.when(F.col("split") == s, F.col("accuracy")))
    others = scored.groupBy(F.col("model").alias("name")).agg(pick("val").alias("val_accuracy"), pick("test").alias("test_accuracy"))
    others = others.withColumns({"type": F.when(F.col("name") == "Two-stage", "two-stage").otherwise("tuned"),
                                 "feature_set": F.when(F.col("name") == "Two-stage", TEXT).otherwise(ALL)})
    rows_e, labels = _embedding_rows(spark, sf)
    emb = fit_linear_svm(rows_e.filter("split = 'train'"), "embedding_vec", "label_index", len(rows_e.first().embedding_vec), len(labels))
    emb_metrics = emb.transform(rows_e.filter("split <> 'train'")).select("split", F.lit("Embedding SVM").alias("model"), F.col("label_index").alias("label"), "prediction")
    emb_row = E.metrics(emb_metrics).groupBy(F.col("model").alias("name")).agg(pick("val").alias("val_accuracy"), pick("test").alias("test_accuracy"))
    emb_row = emb_row.withColumns({"type": F.lit("embedding"), "feature_set": F.lit("embedding")})
    keep = ["name", "type", "feature_set", "val_accuracy", "test_accuracy"]
    tested = reduce(DataFrame.unionByName, [_scored(data, model, name, ("test",)) for name, model in fitted.items()])
    on_test = E.metrics(tested).select(F.col("model").alias("name"), F.col("accuracy").alias("test_accuracy"))
    return E.final_comparison(base.join(on_test, "name", "left").select(*keep), others.select(*keep), emb_row.select(*keep))


@query("hybrid_features")
def _hybrid(spark, sf):
    """Text, embedding and structured blocks side by side, fitted on the training split. A report without embedding stays: its
    block is zero and a flag says so."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ingest_pos"), F.transform("embedding", lambda x: x.cast("double")).alias("_emb"))
    split = stratified_split(checkpoint(prepare_supervised(reports(spark, sf), CONFIG.min_samples, CONFIG.drop_rare)))
    width = emb.agg(F.max(F.size("_emb"))).scalar()
    filled = F.coalesce("_emb", F.array_repeat(F.lit(0.0), F.col("_width")))
    rows = checkpoint(split.join(emb, "ingest_pos", "left").withColumn("_width", width).withColumn("has_embedding", F.col("_emb").isNotNull())
                      .withColumn("embedding_vec", array_to_vector(filled)).drop("_emb", "_width"))
    model, meta = fit_features(rows.filter("split = 'train'"), CONFIG, embedding="embedding_vec")
    vectors = featurise(rows, model, "ingest_pos", "has_embedding", "embedding_vec")
    stored = lambda c: F.size(F.filter(F.unwrap_udt(c)["values"], lambda x: x != 0))
    return vectors.select("ingest_pos", "has_embedding", stored("text_vec").alias("text_nonzeros"), stored("full_vec").alias("full_nonzeros"),
                          F.lit(meta["full_width"]).alias("structured_and_text_width"))
