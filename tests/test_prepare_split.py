import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import tiny_rows
from faultline.config import RunConfig
from faultline.operators import prepare as P
from faultline.operators import ranking as K
from faultline.operators import splits as L


def test_keep_first_and_nulls(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, None, "n1"), (3, None, "n2"), (4, "b", None)], "ingest_pos long, report_id string, team string")
    assert sorted(r.ingest_pos for r in P.keep_first(df).collect()) == [0, 2, 4]
    with pytest.raises(ValueError):
        P.keep_first(df.drop("report_id"))


def test_rare_classes_at_the_threshold(spark):
    rows = [(i, str(i), "big") for i in range(5)] + [(10 + i, str(10 + i), "edge") for i in range(3)] + [(20, "20", "tiny"), (21, "21", None)]
    df = spark.createDataFrame(rows, "ingest_pos long, report_id string, team string")
    merged = {r.target: r["count"] for r in P.prepare_supervised(df, 3).groupBy("target").count().collect()}
    assert merged == {"big": 5, "edge": 3, "other": 1}
    dropped = {r.target: r["count"] for r in P.prepare_supervised(df, 3, drop=True).groupBy("target").count().collect()}
    assert dropped == {"big": 5, "edge": 3}
    report = P.preparation_report(df, 3).first().asDict()
    assert report == {"rows_before": 10, "rows_after_dedup": 10, "null_targets": 1, "rows_labelled": 9, "classes_before": 3, "rare_classes": 1, "rare_rows": 1, "classes_merged": 3}


def test_stratified_split_has_exact_shares(spark):
    rows = [(str(i), "hot" if i % 3 else f"c{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "report_id string, target string")
    got = L.stratified_split(df)
    assert got.count() == 500
    counts = {}
    for r in got.groupBy("target", "split").count().collect():
        counts.setdefault(r.target, {})[r.split] = r["count"]
    for per in counts.values():
        n = sum(per.values())
        assert per.get("train", 0) == int(0.6 * n + 0.5) and per.get("train", 0) + per.get("val", 0) == int(0.8 * n + 0.5)
    again = {r.report_id: r.split for r in L.stratified_split(df.repartition(7)).collect()}
    assert again == {r.report_id: r.split for r in got.collect()}


@pytest.mark.parametrize("hot", [True, False])
def test_temporal_split_by_brute_force(spark, hot):
    rng = random.Random(1)
    day = lambda: "2023-01-05" if hot and rng.random() < 0.5 else f"2023-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    rows = [(str(i), None if rng.random() < 0.1 else day() + " - 01:00:00") for i in range(303)]
    df = spark.createDataFrame(rows, "report_id string, registered string")
    keyed = df.select("report_id", "registered", K.hash_key("report_id", seed=42).alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r.registered is None, r.registered or "", r.h))
    want = {r.report_id: "train" if i < int(303 * 0.6) else "val" if i < int(303 * 0.8) else "test" for i, r in enumerate(order)}
    assert {r.report_id: r.split for r in L.temporal_split(df).collect()} == want


def test_temporal_split_beyond_the_sketch(spark):
    df = spark.range(30011).select(F.col("id").cast("string").alias("report_id"), F.expr("cast(timestamp_ntz'2023-01-01 00:00:00' + make_interval(0,0,0,0,0,0,(id * 7919 % 30011) div 40) as string)").alias("registered"))
    counts = {r.split: r["count"] for r in L.temporal_split(df).groupBy("split").count().collect()}
    assert counts == {"train": int(30011 * 0.6), "val": int(30011 * 0.8) - int(30011 * 0.6), "test": 30011 - int(30011 * 0.8)}


def test_unknown_modes_raise():
    with pytest.raises(ValueError):
        RunConfig(split_mode="magic")
    with pytest.raises(ValueError):
        RunConfig(mode="turbo")


def test_split_contract(spark):
    rows = [("train", "a"), ("val", "a"), ("val", "b"), ("test", "b"), ("test", None), ("test", "c")]
    got = {(r.split, r.value) for r in L.split_contract(spark.createDataFrame(rows, "split string, x string"), ["x"]).collect()}
    assert got == {("val", "b"), ("test", "b"), ("test", "c")}


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 25000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n).round(3))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.prob: r.value for r in K.exact_quantiles(df, ["x"], probs).collect()}
    assert np.allclose([got[p] for p in probs], np.percentile(x, [p * 100 for p in probs]))


def test_hash_ranks_and_running_sums(spark):
    df = spark.range(2000).withColumn("h", K.hash_key("id")).withColumn("g", F.col("id") % 2)
    ranks = K.hash_ranks(df, "h", ["g"]).collect()
    for g in (0, 1):
        own = sorted((r.h, r["rank"]) for r in ranks if r.g == g)
        assert [k for _, k in own] == list(range(1, 1001))
    values = spark.range(1000).select((F.col("id") / 1000).alias("k"), F.lit(1).cast("long").alias("n"))
    got = sorted((r.k, r.c) for r in K.running_sums(values, "k", {"c": "n"}, bounds=16).collect())
    assert [c for _, c in got] == list(range(1000, 0, -1))
