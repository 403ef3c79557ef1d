"""A pass of a fit: one stage while its sums are small, the same sums in pieces; fits that run side by side."""

import threading

import numpy as np
from pyspark.ml.linalg import Vectors

from faultline.operators import linear_svm as L
from faultline.operators import models
from faultline.session import side_by_side


def _rows(spark, n=24):
    return L.training_rows(spark.createDataFrame([(Vectors.dense([float(i % 7), 0.0, i / 3]), i % 3) for i in range(n)], ["v", "y"]), "v", "y")


def test_small_sums_need_one_stage_and_equal_those_in_pieces(spark, monkeypatch):
    rows, arrays, weights = L.packed(_rows(spark)), L._Arrays([L.Problem(k, [0, 1, 2]) for k in range(3)], 3), np.arange(12.0).reshape(3, 4) / 10
    rows.count()
    sc = spark.sparkContext
    sc.setJobGroup("one pass", "one pass")
    try:
        whole = L._partial_sums(rows, arrays, weights)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("one pass")
    assert len(jobs) == 1 and len(sc.statusTracker().getJobInfo(jobs[0]).stageIds) == 1
    monkeypatch.setattr(L, "DIRECT", 0)
    monkeypatch.setattr(L, "SLAB", 4)
    assert np.array_equal(whole, L._partial_sums(rows, arrays, weights))
    rows.unpersist()


def test_a_fit_reads_a_frame_or_its_kept_batches(spark):
    problems = L.one_vs_rest([0, 1, 2])
    kept = L.packed(_rows(spark))
    assert np.array_equal(L.fit_problems(_rows(spark), problems, 3, 3), L.fit_problems(kept, problems, 3, 3))
    kept.unpersist()


def test_calls_run_side_by_side_and_answer_in_order():
    met = threading.Barrier(3, timeout=20)
    assert side_by_side(*[lambda i=i: (met.wait(), i)[1] for i in range(3)]) == [0, 1, 2] and side_by_side() == []


def test_baselines_are_fitted_side_by_side(trained, tiny_config, monkeypatch):
    met, fit = threading.Barrier(len(models.baseline_runs(tiny_config)), timeout=60), models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda *a, **k: (met.wait(), fit(*a, **k))[1])
    data = trained.prepared
    rows, fitted = models.compare_baselines(data.vectors, data.n_classes, tiny_config)
    assert {r["name"] for r in rows} == set(fitted) and len(rows) == 5
