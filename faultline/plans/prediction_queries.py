"""Queries over a predictions table: metrics, confidence, significance.

The predictions come from the events table: the label is the event type, and a model predicts the
most frequent type of the row's group (user and hour, or user and day) with its share as confidence.
Such predictions are cheap, cover the whole table, have many equal confidences, and SQL can replay
them exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import confidence as C
from ..operators import evaluation as E
from ..operators import significance as G
from .report_view import table

QUERIES, SQL = {}, {}
MODEL_A, MODEL_B = "by_user_hour", "by_user_day"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def predictions(spark, sf, *models: str):
    events = table(spark, sf, "events").select(F.col("event_id").alias("report_id"), "user_id", "ts", F.col("event_type").alias("label"))
    split = F.when(F.dayofmonth("ts") <= 18, "train").otherwise("val")
    parts = []
    for model in models or (MODEL_A, MODEL_B):
        slot = F.hour("ts") if model == MODEL_A else F.dayofmonth("ts")
        rows = events.withColumns({"slot": slot, "split": split})
        modes = (rows.groupBy("user_id", "slot", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id", "slot")
                 .agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("prediction"), (F.max("n") / F.sum("n")).alias("confidence")))
        parts.append(rows.join(modes, ["user_id", "slot"]).select("report_id", F.lit(model).alias("model"), "split", "label", "prediction", "confidence"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _model_sql(model: str) -> str:
    slot = "hour(ts)" if model == MODEL_A else "day(ts)"
    return (f"SELECT event_id AS report_id, '{model}' AS model, CASE WHEN day(ts) <= 18 THEN 'train' ELSE 'val' END AS split, event_type AS label, m.prediction, m.confidence "
            f"FROM events e JOIN (SELECT user_id, slot, arg_max(event_type, (n, -ord)) AS prediction, max(n) / sum(n) AS confidence FROM "
            f"(SELECT user_id, {slot} AS slot, event_type, count(*) AS n, dense_rank() OVER (ORDER BY event_type) AS ord FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) m "
            f"ON e.user_id = m.user_id AND {slot} = m.slot")


_BOTH = f"p AS ({_model_sql(MODEL_A)} UNION ALL {_model_sql(MODEL_B)})"
_ONE = f"p AS ({_model_sql(MODEL_A)})"
_PER_CLASS = f"""{_BOTH}, k AS (SELECT model, split, class, sum(tp) AS tp, sum(s) AS s, sum(d) AS d FROM
    (SELECT model, split, label AS class, (label = prediction)::INTEGER AS tp, 1 AS s, 0 AS d FROM p UNION ALL SELECT model, split, prediction, 0, 0, 1 FROM p) GROUP BY 1, 2, 3),
    q AS (SELECT model, split, class, CASE WHEN d = 0 THEN 0 ELSE tp / d END AS precision, CASE WHEN s = 0 THEN 0 ELSE tp / s END AS recall, 2 * tp / (s + d) AS f1, s AS support, tp FROM k)"""
_METRICS = f"""{_PER_CLASS}, m AS (SELECT model, split, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS n_samples FROM q GROUP BY 1, 2)"""


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("metrics", f"""WITH {_METRICS} SELECT v.model, v.split, round(v.accuracy, 6) AS accuracy, round(v.macro_f1, 6) AS macro_f1, round(v.weighted_f1, 6) AS weighted_f1, v.n_samples,
       round(t.accuracy, 6) AS train_accuracy, round(t.accuracy - v.accuracy, 6) AS gap FROM m v LEFT JOIN m t ON t.model = v.model AND t.split = 'train' WHERE v.split = 'val'""")
def _metrics(spark, sf):
    return _round(E.metrics_with_gap(predictions(spark, sf)), "accuracy", "macro_f1", "weighted_f1", "train_accuracy", "gap")


@query("class_report", f"""WITH {_PER_CLASS} SELECT model, split, class, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support FROM q
       UNION ALL SELECT model, split, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM q GROUP BY 1, 2
       UNION ALL SELECT model, split, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM q GROUP BY 1, 2""")
def _class_report(spark, sf):
    return _round(E.class_report(predictions(spark, sf)), "precision", "recall", "f1")


@query("confusion_pairs", f"""WITH {_BOTH}, c AS (SELECT model, label, prediction, count(*) AS n_rows FROM p WHERE label <> prediction GROUP BY 1, 2, 3)
       SELECT model, rank, label, prediction, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n_rows DESC, label, prediction) AS rank FROM c) WHERE rank <= 10""")
def _pairs(spark, sf):
    return E.confusion_pairs(predictions(spark, sf))


def _accuracy_by(spark, sf, key):
    """Validation accuracy per model and step, as a result table."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("report_id"), key.alias("step"))
    return (predictions(spark, sf).join(events, "report_id").groupBy("model", "step")
            .agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("val_accuracy")))


_STEPS = f"{_BOTH}, a AS (SELECT model, weekday_no AS step, avg((label = prediction)::INTEGER) AS val_accuracy FROM p JOIN (SELECT event_id, isodow(ts) - 1 AS weekday_no FROM events) e ON e.event_id = p.report_id GROUP BY 1, 2)"


@query("best_per_group", f"""WITH {_STEPS} SELECT model, step, round(val_accuracy, 6) AS val_accuracy FROM
       (SELECT *, row_number() OVER (PARTITION BY step ORDER BY val_accuracy DESC NULLS LAST, model) AS rn FROM a) WHERE rn = 1""")
def _best_per_group(spark, sf):
    return _round(E.best_per_group(_accuracy_by(spark, sf, F.weekday("ts").cast("long")), "step", "val_accuracy", "model"), "val_accuracy")


@query("best_run", f"WITH {_STEPS} SELECT model || ' day ' || step AS name, round(val_accuracy, 6) AS val_accuracy FROM a ORDER BY a.val_accuracy DESC, name LIMIT 1")
def _best_run(spark, sf):
    runs = _accuracy_by(spark, sf, F.weekday("ts")).select(F.concat("model", F.lit(" day "), F.col("step").cast("string")).alias("name"), "val_accuracy")
    return _round(E.best_run(runs), "val_accuracy")


@query("marginal_gain", f"WITH {_STEPS} SELECT step, round(val_accuracy, 6) AS val_accuracy, round(val_accuracy - lag(val_accuracy) OVER (ORDER BY step), 6) AS gain FROM a WHERE model = '{MODEL_A}'")
def _gain(spark, sf):
    steps = _accuracy_by(spark, sf, F.weekday("ts").cast("long")).filter(F.col("model") == MODEL_A).drop("model")
    return _round(E.marginal_gain(steps, "step", "val_accuracy"), "val_accuracy", "gain")


@query("bias_variance", f"""WITH {_METRICS} SELECT v.model, round(t.accuracy, 6) AS train_accuracy, round(v.accuracy, 6) AS accuracy, round(t.accuracy - v.accuracy, 6) AS gap,
       CASE WHEN t.accuracy - v.accuracy > 0.15 THEN 'high variance' WHEN v.accuracy < 0.5 THEN 'high bias' ELSE 'ok' END AS verdict FROM m v JOIN m t ON t.model = v.model AND t.split = 'train' WHERE v.split = 'val'""")
def _verdict(spark, sf):
    scored = E.metrics_with_gap(predictions(spark, sf)).select("model", "train_accuracy", "accuracy")
    return _round(E.bias_variance(scored, "train_accuracy", "accuracy"), "train_accuracy", "accuracy", "gap")


# ---------------------------------------------------------------- confidence
@query("precision_coverage", f"""WITH {_ONE}, c AS (SELECT confidence, count(*) AS n, sum((label = prediction)::INTEGER) AS ok FROM p GROUP BY 1),
       x AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS n_routed, sum(ok) OVER (ORDER BY confidence DESC) AS n_correct FROM c)
       SELECT round(confidence, 6) AS threshold, n_routed::BIGINT AS n_routed, n_correct::BIGINT AS n_correct, round(n_routed / (SELECT count(*) FROM p), 6) AS coverage, round(n_correct / n_routed, 6) AS precision FROM x""")
def _curve(spark, sf):
    return _round(C.precision_coverage(predictions(spark, sf, MODEL_A)), "threshold", "coverage", "precision")


@query("operating_points", f"""WITH {_ONE}, o AS (SELECT confidence, row_number() OVER w AS rk, sum((label = prediction)::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) AS ok, count(*) OVER () AS n FROM p
       WINDOW w AS (ORDER BY confidence DESC, md5(report_id::VARCHAR)))
       SELECT coverage, rk AS k, round(ok / rk, 6) AS precision, round(confidence, 6) AS threshold FROM o JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS coverage) c ON rk = greatest(1, floor(n * coverage + 1e-9))""")
def _points(spark, sf):
    return _round(C.operating_points(predictions(spark, sf, MODEL_A)), "precision", "threshold")


_EDGES = ", ".join(f"quantile_cont(confidence, {i / 10})" for i in range(1, 10))


@query("calibration_bins", f"""WITH {_ONE}, e AS (SELECT [{_EDGES}] AS edges FROM p)
       SELECT len(list_filter(edges, lambda x: x < confidence))::INTEGER AS bin, count(*) AS n_rows, round(avg(confidence), 6) AS mean_confidence, round(avg((label = prediction)::INTEGER), 6) AS fraction_correct FROM p, e GROUP BY 1""")
def _bins(spark, sf):
    return _round(C.reliability_bins(predictions(spark, sf, MODEL_A)), "mean_confidence", "fraction_correct")


@query("threshold_sweep", f"""WITH {_ONE} SELECT t AS threshold, count(*) FILTER (confidence >= t) AS n_routed, round(count(*) FILTER (confidence >= t) * 100.0 / count(*), 6)::DOUBLE AS coverage_pct,
       coalesce(round(count(*) FILTER (confidence >= t AND label = prediction) * 100.0 / nullif(count(*) FILTER (confidence >= t), 0), 6), 0)::DOUBLE AS accuracy_pct
       FROM p, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) GROUP BY t""")
def _sweep(spark, sf):
    return _round(C.threshold_sweep(predictions(spark, sf, MODEL_A)), "coverage_pct", "accuracy_pct")


@query("confidence_gate", f"""WITH {_ONE} SELECT count(*) AS n_rows, count(*) FILTER (confidence >= 0.7) AS n_auto, count(*) FILTER (confidence < 0.7) AS n_human,
       round(count(*) FILTER (confidence >= 0.7) * 100.0 / count(*), 6)::DOUBLE AS auto_pct, round(count(*) FILTER (confidence < 0.7) * 100.0 / count(*), 6)::DOUBLE AS human_pct,
       coalesce(round(count(*) FILTER (confidence >= 0.7 AND label = prediction) / nullif(count(*) FILTER (confidence >= 0.7), 0), 6), 0)::DOUBLE AS auto_accuracy,
       round(avg((label = prediction)::INTEGER), 6) AS overall_accuracy FROM p""")
def _gate(spark, sf):
    return _round(C.gate_report(predictions(spark, sf, MODEL_A)), "auto_pct", "human_pct", "auto_accuracy", "overall_accuracy")


@query("routed_rows", f"WITH {_ONE} SELECT report_id, prediction, CASE WHEN confidence >= 0.7 THEN 'auto' ELSE 'human' END AS routing FROM p")
def _routed(spark, sf):
    return C.route(predictions(spark, sf, MODEL_A)).select("report_id", "prediction", "routing")


@query("confidence_hist", f"""WITH {_ONE}, e AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM p)
       SELECT least(floor((confidence - lo) / (hi - lo) * 50), 49)::INTEGER AS bin, count(*) AS n_rows FROM p, e GROUP BY 1""")
def _hist(spark, sf):
    return C.confidence_histogram(predictions(spark, sf, MODEL_A))


# ---------------------------------------------------------------- significance
@query("mcnemar", f"""WITH {_BOTH}, b AS (SELECT report_id, max((label = prediction)::INTEGER) FILTER (model = '{MODEL_A}') AS a, max((label = prediction)::INTEGER) FILTER (model = '{MODEL_B}') AS b FROM p GROUP BY 1),
       t AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS both_right, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither FROM b),
       x AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS m FROM t),
       y AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END AS p_value FROM x)
       SELECT both_right, only_a, only_b, neither, round(p_value, 6)::DOUBLE AS p_value, CASE WHEN p_value < 0.05 THEN 'different' ELSE 'no significant difference' END AS verdict FROM y""")
def _mcnemar(spark, sf):
    return _round(G.mcnemar(predictions(spark, sf), MODEL_A, MODEL_B), "p_value")


@query("bootstrap_ci")
def _bootstrap(spark, sf):
    return G.bootstrap_ci(predictions(spark, sf))
