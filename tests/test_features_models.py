import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from faultline.config import RunConfig
from faultline.functions.stopwords import english_stop_words
from faultline.operators import calibration, features, linear_svm, models, search
from faultline.operators.scoring import predict_record, predict_reports
from faultline.operators.vocabulary import fit_section_tfidf, section_terms
from faultline.sources.bundle import load_bundle, save_bundle
from faultline.streaming.scoring import score_stream


def test_stop_words(spark):
    words = english_stop_words()
    assert len(words) == 318 and {"the", "system", "fire", "whereupon"} <= set(words) and not {"did", "just"} & set(words)


def test_term_counts_by_hand(spark):
    texts = ["node restart node", "restart the board", "board board x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.term: (r.total, r.docs) for r in section_terms(df, {"s": "t"}, ["the"], 2).collect()}
    total, docs = Counter(), Counter()
    for t in texts:
        words = [w for w in t.split() if len(w) > 1 and w != "the"]
        terms = words + [" ".join(p) for p in zip(words, words[1:])]
        total.update(terms)
        docs.update(set(terms))
    assert got == {t: (total[t], docs[t]) for t in total}


def test_tfidf_rows_have_unit_norm_and_ties_are_ordered(spark):
    texts = ["alpha beta", "alpha gamma", "beta gamma delta", "delta", "zeta omega", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fitted, sizes = fit_section_tfidf(df, {"s": "t"}, {"s": 3}, 1, [])
    assert fitted["s"].stages[1].vocabulary == ["alpha", "beta", "delta"] and sizes == {"s": 3}
    rows = [r[0] for r in fitted["s"].transform(df).select(vector_to_array("tfidf_s")).collect()]
    idf = math.log(7 / 3) + 1
    assert np.allclose(rows[0], np.array([idf, idf, 0]) / np.linalg.norm([idf, idf]))
    assert all(math.isclose(np.linalg.norm(r), 1) or np.linalg.norm(r) == 0 for r in rows)


def test_empty_vocabulary_falls_back(spark):
    df = spark.createDataFrame([("the same",), ("the same",), ("",)], "t string")
    fitted, _ = fit_section_tfidf(df.filter("t <> ''"), {"s": "t"}, {"s": 100})
    assert fitted["s"].stages[1].vocabulary == ["same", "the"]
    fitted, _ = fit_section_tfidf(spark.createDataFrame([("",), ("",)], "t string"), {"s": "t"}, {"s": 100})
    assert fitted["s"].stages[1].vocabulary == ["empty"]


def test_scaler_and_one_hot(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    model = features.fit_scaler(df, ["a", "b"], "z")
    assert [r[0] for r in model.transform(df).select(vector_to_array("z")).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    from pyspark.ml import Pipeline
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    hot = Pipeline(stages=features.one_hot_stages(["c"])).fit(train)
    got = hot.transform(spark.createDataFrame([("a",), ("b",), ("new",)], "c string")).select(vector_to_array("hot_c")).collect()
    assert [r[0] for r in got] == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_safe_label_raise(spark):
    df = spark.createDataFrame([("train", "a"), ("val", "b")], "split string, t string")
    assert [r.t_index for r in features.safe_label(df, "t").collect()] == [1, 0]
    with pytest.raises(Exception, match="unseen label"):
        features.safe_label(df, "t", "raise").collect()


def _svm_objective(w, x, sign, weight):
    gap = np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1]))
    return 0.5 * w @ w + (weight * gap**2).sum()


def _gradient_descent(x, sign, weight):
    w = np.zeros(x.shape[1] + 1)
    xb = np.c_[x, np.ones(len(x))]
    step = 1 / (1 + 2 * np.linalg.norm(xb * np.sqrt(weight)[:, None], 2) ** 2)
    for _ in range(20000):
        gap = np.maximum(0, 1 - sign * (xb @ w))
        w -= step * (w - 2 * xb.T @ (weight * sign * gap))
    return w


def test_squared_hinge_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((60, 5)) < 0.5, 0, rng.normal(size=(60, 5)))
    x[0] = 0                                            # an empty row
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(int) + (x[:, 1] > 0.5)
    df = spark.createDataFrame([(Vectors.sparse(5, {j: float(v) for j, v in enumerate(r) if v}) if i % 2 else Vectors.dense(r), int(k), i % 3)
                                for i, (r, k) in enumerate(zip(x, y))], ["vec", "y", "fold"]).repartition(3)
    rows = linear_svm.training_rows(df, "vec", "y", fold="fold")
    problems = [linear_svm.Problem(k, [0, 1, 2], 0.7, {1: 2.0}, without_fold=f) for k in (0, 1, 2) for f in (-1, 1)]
    problems.append(linear_svm.Problem(2, [0, 1, 2], ranges=[(1, 3)]))
    found = linear_svm.fit_problems(rows, problems, 5, 3, tol=1e-5)
    for p, w in zip(problems[:-1], found):
        keep = np.arange(60) % 3 != p.without_fold
        sign, weight = np.where(y == p.positive, 1, -1)[keep], 0.7 * np.where(y == 1, 2.0, 1.0)[keep]
        best = _gradient_descent(x[keep], sign, weight)
        assert _svm_objective(w, x[keep], sign, weight) <= _svm_objective(best, x[keep], sign, weight) * (1 + 1e-4)
    assert np.all(found[-1][[0, 3, 4]] == 0) and np.any(found[-1][1:3] != 0)
    model = linear_svm.LinearSVMModel(found[[0, 2, 4]], "vec")
    scores = np.c_[x, np.ones(60)] @ found[[0, 2, 4]].T
    got = {tuple(r.vec.toArray()): r.prediction for r in model.transform(df).collect()}
    assert all(got[tuple(r)] == s.argmax() for r, s in zip(x, scores))


def test_sigmoids_reach_the_optimum(spark):
    rng = np.random.default_rng(1)
    scores, y = rng.normal(size=(200, 2)), rng.integers(0, 2, 200)
    scores[:, 1] += y
    df = spark.createDataFrame([(0, int(k), [float(v) for v in s]) for s, k in zip(scores, y)], "fold int, y int, scores array<double>")
    a, b = calibration.fit_sigmoids(df, 1, 2)
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = 1 / (1 + np.exp(a[0, 1] * scores[:, 1] + b[0, 1]))
    assert a[0, 1] < 0 and abs((t - p).sum()) < 0.05 and abs(((t - p) * scores[:, 1]).sum()) < 0.05


def test_matrix_min_and_baseline_specs(spark, trained, tiny_config):
    assert models.matrix_min(trained.prepared.vectors, "text_vec") >= 0
    assert [fs for m, fs in models.baseline_runs(tiny_config) if m == "Multinomial NB"] == ["TF-IDF only"]
    assert len(models.baseline_runs(RunConfig(mode="full"))) == 7
    with pytest.raises(ValueError):
        features.feature_column("other")


def test_comparison_table(trained):
    frame = trained.result_frame()
    assert {"model", "feature_set", "val_accuracy", "macro_f1", "weighted_f1", "time_s", "warnings"} <= set(frame.columns)
    rows = frame.collect()
    assert "Multinomial NB" in {r.model for r in rows} and trained.models
    accuracies = [r.val_accuracy for r in rows]
    assert accuracies == sorted(accuracies, reverse=True) and accuracies[0] == 1.0


def test_block_widths(trained):
    meta = trained.prepared.metadata
    row = trained.prepared.vectors.first()
    assert len(row.text_vec) == meta["text_width"] and len(row.full_vec) == meta["full_width"]


def test_cause_is_blank_outside_training(trained):
    offset = sum(trained.prepared.metadata["tfidf_sections"][s] for s in ("heading", "effect", "config"))
    rows = trained.prepared.vectors.select("split", vector_to_array("text_vec").alias("v")).collect()
    assert all((sum(r.v[offset:]) > 0) == (r.split == "train") for r in rows)


def test_saved_bundle_predicts_the_same(spark, trained, tiny, tmp_path):
    loaded = load_bundle(save_bundle(trained.bundle, str(tmp_path / "bundle"), spark), spark)
    assert loaded.model_name == trained.bundle.model_name and loaded.config == trained.bundle.config
    pick = lambda b: sorted((r.report_id, r.prediction) for r in predict_reports(tiny, b).collect())
    assert pick(loaded) == pick(trained.bundle)
    for name, model in trained.models.items():
        trained.bundle.classifier = model
        record = predict_record(spark, trained.bundle, heading="UE traffic stops after handover", observation="Cell disabled alarm", priority="B")
        assert record["prediction"] in ("TeamA", "TeamB"), name
        assert ("confidence" in record) == (not name.startswith("Linear SVM"))
    trained.bundle.classifier = loaded.classifier


def test_stream_equals_batch(spark, trained, tiny, tmp_path):
    tiny.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tiny.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, trained.bundle).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.report_id, r.prediction) for r in spark.table("scored").collect())
    assert got == sorted((r.report_id, r.prediction) for r in predict_reports(tiny, trained.bundle).collect())
    with pytest.raises(ValueError):
        score_stream(tiny, trained.bundle)


def test_two_stage_search_and_importance(spark, trained):
    data = trained.prepared
    flat = trained.models["Linear SVM [TF-IDF only]"]
    two, report = models.fit_two_stage(data.vectors, data.n_classes, flat, min_train=2)
    assert report == [] and two.transform(data.vectors).filter(F.col("prediction") != F.col("label_index")).count() == 0
    grid = search.grid_search_svm(data.split("train"), "full_vec", data.n_classes, data.config)
    assert len(grid.rows) == 4 and grid.best["cv_accuracy"] == 1.0
    curve = search.learning_curve(data.split("train"), "text_vec", data.n_classes, data.config)
    assert [round(r["share"], 2) for r in curve] == [0.2, 0.47, 0.73, 1.0] and curve[-1]["val_mean"] == 1.0
    drops = search.permutation_importance(data.vectors, trained.models["Linear SVM [TF-IDF + All]"])
    assert {r["block"] for r in drops} == set(features.BLOCKS) and all(r["base_accuracy"] == 1.0 for r in drops)
    calibrated = calibration.fit_calibrated_svm(data.split("train"), "full_vec", "label_index", data.metadata["full_width"], data.n_classes)
    rows = calibrated.transform(data.split("test")).collect()
    assert all(math.isclose(sum(r.probability), 1) and r.prediction == r.label_index for r in rows)


def test_two_stage_routes_within_units(spark):
    """Two units whose teams can only be told apart by the unit's own classifier."""
    rows = []
    for i in range(120):
        unit, kind = i % 2, (i // 2) % 2
        team = unit * 2 + (kind if unit == 0 else 1 - kind)
        rows.append((str(i), ["u0", "u1"][unit], ["train", "val", "test"][0 if i < 80 else 1 if i < 100 else 2], float(team),
                     Vectors.dense([1.0 - unit, float(unit), float(kind), 1.0 - kind]), ))
    df = spark.createDataFrame(rows, ["report_id", "unit", "split", "label_index", "text_vec"])
    flat = linear_svm.LinearSVMModel(np.zeros((4, 5)), "text_vec")
    two, report = models.fit_two_stage(df, 4, flat)
    assert [r["unit"] for r in report] == ["u0", "u1"] and all(r["val_accuracy"] == 1.0 for r in report)
    assert two.transform(df).filter(F.col("prediction") != F.col("label_index")).count() == 0
