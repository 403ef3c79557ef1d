import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import confidence as C
from faultline.operators import evaluation as E
from faultline.operators import significance as G


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        label = "abc"[rng.integers(3)]
        for m, p in (("m1", 0.7), ("m2", 0.6)):
            guess = label if rng.random() < p else "abcd"[rng.integers(4)]
            rows.append((str(i), m, "train" if i < 300 else "val", label, guess, 1.0 if i % 3 == 0 else float(np.round(rng.random(), 2))))
    return spark.createDataFrame(rows, "report_id string, model string, split string, label string, prediction string, confidence double").cache()


def test_metrics_by_hand(predictions):
    rows = [r for r in predictions.collect() if r.model == "m1" and r.split == "val"]
    f1s, weighted = [], 0
    for c in sorted({r.label for r in rows} | {r.prediction for r in rows}):
        tp = sum(r.label == c == r.prediction for r in rows)
        s, d = sum(r.label == c for r in rows), sum(r.prediction == c for r in rows)
        f1s.append(2 * tp / (s + d))
        weighted += f1s[-1] * s / len(rows)
    got = E.metrics(predictions).filter("model = 'm1' and split = 'val'").first()
    assert math.isclose(got.accuracy, sum(r.label == r.prediction for r in rows) / len(rows))
    assert math.isclose(got.macro_f1, sum(f1s) / len(f1s)) and math.isclose(got.weighted_f1, weighted)


def test_operating_points_by_brute_force(predictions):
    from faultline.operators.ranking import hash_key
    one = predictions.filter("model = 'm1'")
    rows = sorted(one.withColumn("h", hash_key("report_id")).collect(), key=lambda r: (-r.confidence, r.h))
    for r in C.operating_points(one).collect():
        k = max(1, int(r.coverage * len(rows) + 1e-9))
        assert r.k == k and r.threshold == rows[k - 1].confidence
        assert math.isclose(r.precision, sum(x.label == x.prediction for x in rows[:k]) / k)


def test_reliability_bins_by_brute_force(predictions):
    one = predictions.filter("model = 'm2'").collect()
    conf = np.array([r.confidence for r in one])
    ok = np.array([r.label == r.prediction for r in one])
    edges = np.percentile(conf, np.linspace(0, 100, 11))
    bins = np.searchsorted(edges[1:-1], conf)
    got = {r.bin: r for r in C.reliability_bins(predictions.filter("model = 'm2'")).collect()}
    assert set(got) == set(bins)
    for b in set(bins):
        assert math.isclose(got[b].mean_confidence, conf[bins == b].mean()) and math.isclose(got[b].fraction_correct, ok[bins == b].mean())


def test_gate_counts_add_up(predictions):
    r = C.gate_report(predictions.filter("model = 'm1'")).first()
    assert r.n_auto + r.n_human == r.n_rows == 600
    empty = C.gate_report(predictions.withColumn("confidence", F.lit(None).cast("double"))).first()
    assert empty.n_auto == 0 and empty.auto_accuracy == 0


def test_mcnemar(spark):
    assert G._two_sided_binomial(0, 0) == 1.0
    assert math.isclose(G._two_sided_binomial(1, 9), 2 * sum(math.comb(10, i) for i in range(2)) / 2**10)
    assert G._two_sided_binomial(5, 5) == 1.0
    assert 0 < G._two_sided_binomial(10**7, 10**7 + 20000) < 1e-4
    rows = [(str(i), m, "x", "x") for i in range(5) for m in ("a", "b")]
    same = spark.createDataFrame(rows, "report_id string, model string, label string, prediction string")
    got = G.mcnemar(same, "a", "b").first()
    assert got.both_right == 5 and got.p_value == 1.0 and got.verdict.startswith("no")


def test_bootstrap_close_to_row_resampling(predictions):
    rows = [r for r in predictions.collect() if r.model == "m1"]
    ok = np.array([r.label == r.prediction for r in rows])
    rng = np.random.default_rng(0)
    draws = [ok[rng.integers(0, len(ok), len(ok))].mean() for _ in range(1000)]
    got = {r.metric: r for r in G.bootstrap_ci(predictions).filter("model = 'm1'").collect()}
    assert math.isclose(got["accuracy"].value, ok.mean())
    assert abs(got["accuracy"].low - np.percentile(draws, 2.5)) < 0.015 and abs(got["accuracy"].high - np.percentile(draws, 97.5)) < 0.015
    assert got["macro_f1"].low < got["macro_f1"].value < got["macro_f1"].high


def test_best_run_and_final_table(spark):
    runs = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "name string, val_accuracy double")
    assert E.best_run(runs).first().name == "a"
    table = E.final_comparison(runs, spark.createDataFrame([("z", 0.9, 0.8)], "name string, val_accuracy double, test_accuracy double")).collect()
    assert [r.name for r in table] == ["z", "a", "b", "c"] and table[1].test_accuracy is None


def test_missing_confidence_is_the_lowest(spark):
    rows = [(i, "a", "a" if i % 3 else "b", None if i >= 13 else i / 20) for i in range(20)]
    frame = spark.createDataFrame(rows, "report_id long, label string, prediction string, confidence double")
    points = C.operating_points(frame).orderBy("coverage").collect()
    assert [r["coverage"] for r in points] == [0.5, 0.6, 0.7, 0.8, 0.9, 1.0] and [r["threshold"] is None for r in points] == [False, False, True, True, True, True]
    curve = C.precision_coverage(frame).collect()
    assert max(r["n_routed"] for r in curve) == 20 and sum(r["threshold"] is None for r in curve) == 1
    nothing = frame.withColumn("confidence", F.lit(None).cast("double"))
    assert C.operating_points(nothing).count() == 6 and C.precision_coverage(nothing).count() == 1


def test_exact_p_of_a_lopsided_table_is_fast():
    from faultline.operators.significance import _two_sided_binomial
    assert _two_sided_binomial(1_200_000, 800_000) == 0.0 and abs(_two_sided_binomial(5, 1) - 0.21875) < 1e-12


def test_bootstrap_does_not_depend_on_chunks(predictions):
    rows = lambda chunk: sorted(map(tuple, G.bootstrap_ci(predictions, resamples=60, chunk=chunk).collect()))
    assert rows(60) == rows(7) and {r[-1] for r in rows(7)} == {60}
