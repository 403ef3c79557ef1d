"""Models made of other models and stacked weights: save, load, equal predictions."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import tiny_rows, TINY_SCHEMA
from faultline.jobs import score_job, train_job
from faultline.operators import calibration, linear_svm, models
from faultline.operators.scoring import predict_and_route, predict_reports
from faultline.sources.bundle import ModelBundle, load_bundle, save_bundle


def units(spark):
    rows = []
    for i in range(120):
        unit, kind = i % 2, (i // 2) % 2
        team = unit * 2 + (kind if unit == 0 else 1 - kind)
        rows.append((str(i), ["u0", "u1"][unit], ["train", "val", "test"][0 if i < 80 else 1 if i < 100 else 2], float(team),
                     Vectors.dense([1.0 - unit, float(unit), float(kind), 1.0 - kind])))
    return spark.createDataFrame(rows, ["report_id", "unit", "split", "label_index", "text_vec"])


def predictions(model, df):
    return [(r.report_id, r.prediction) for r in model.transform(df).select("report_id", "prediction").orderBy("report_id").collect()]


def test_two_stage_round_trip(spark, tmp_path):
    df = units(spark)
    flat = PipelineModel([linear_svm.LinearSVMModel(np.eye(4, 5), "text_vec")])
    two, _ = models.fit_two_stage(df, 4, flat)
    PipelineModel([two]).write().save(str(tmp_path / "two"))
    again = PipelineModel.load(str(tmp_path / "two"))
    assert predictions(again, df) == predictions(two, df)
    back = again.stages[0]
    assert (back.units, back.slices, back.classes) == (two.units, two.slices, two.classes) and np.array_equal(back.team_weights, two.team_weights)


def test_two_stage_without_team_models_round_trip(spark, tmp_path):
    df = units(spark)
    flat = PipelineModel([linear_svm.LinearSVMModel(np.eye(4, 5), "text_vec")])
    two, report = models.fit_two_stage(df, 4, flat, min_train=1000)
    assert report == [] and two.team_weights is None
    two.write().save(str(tmp_path / "flat"))
    assert predictions(models.TwoStageModel.load(str(tmp_path / "flat")), df) == predictions(two, df)


def test_calibrated_bundle_round_trip(spark, trained, tiny, tmp_path):
    data = trained.prepared
    fitted = calibration.fit_calibrated_svm(data.split("train"), "full_vec", "label_index", data.metadata["full_width"], data.n_classes)
    bundle = ModelBundle(data.features, PipelineModel([fitted]), data.labels, "calibrated", "TF-IDF + All", data.config, data.metadata, {})
    save_bundle(bundle, str(tmp_path / "bundle"), spark)
    save_bundle(bundle, str(tmp_path / "bundle"), spark)                       # written over
    loaded = load_bundle(str(tmp_path / "bundle"), spark)
    rows = lambda b: [(r.report_id, r.prediction, round(r.confidence, 12)) for r in predict_reports(tiny, b).orderBy("report_id").collect()]
    assert rows(loaded) == rows(bundle)
    assert {r.routing for r in predict_and_route(tiny, loaded, 0.5).collect()} == {"auto"}


def test_train_job_stores_a_calibrated_model_and_score_job_routes_by_it(spark, tmp_path):
    spark.createDataFrame(tiny_rows(), TINY_SCHEMA).write.parquet(str(tmp_path / "reports"))
    result = train_job.run(spark, str(tmp_path / "reports"), str(tmp_path / "model"), ["min_samples=1", "calibrate=true"])
    assert result.bundle.model_name.endswith("calibrated")
    spark.createDataFrame(tiny_rows(), TINY_SCHEMA).write.parquet(str(tmp_path / "new"))
    score_job.run(spark, score_job.parse_args(["--model", str(tmp_path / "model"), "--input", str(tmp_path / "new"), "--output", str(tmp_path / "scored"), "--threshold", "0.5"]))
    scored = spark.read.parquet(str(tmp_path / "scored"))
    assert scored.filter("confidence IS NULL").count() == 0
    assert scored.filter("routing = 'auto'").count() == 16 and scored.filter(F.col("prediction") == F.col("team")).count() == 16
