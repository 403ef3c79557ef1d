"""Queries over fitted features: vocabulary, TF-IDF, scaling, one-hot and label encoding."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import signals as S
from ..functions import text as X
from ..functions.stopwords import english_stop_words
from ..operators.features import (
    NUMERIC, PRIORITY, SECTIONS, ColumnScalerModel, ReportColumns, fit_scaler, one_hot_stages, population_scale, safe_label,
)
from ..operators.similarity import best_k
from ..operators.text_topk import sparse_unit
from ..operators.vocabulary import fit_section_tfidf, section_terms, top_terms
from ..session import checkpoint
from . import sql as Q
from .report_queries import MIN_SAMPLES, reports, split_rows, split_sql

QUERIES, SQL = {}, {}
BALANCED = RunConfig(mode="balanced", min_samples=MIN_SAMPLES)
FAST = RunConfig(mode="fast", min_samples=MIN_SAMPLES)
_TEXT_INPUTS = ["heading", "observation", "answer"]


def query(name: str, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def section_texts(split):
    """Cleaned section texts; the cause only for training rows."""
    return split.select(
        "report_id", "target", "split", X.clean_text("heading").alias("heading"), X.clean_text(X.section("observation", "effect")).alias("effect"),
        X.clean_alphanum(X.section("observation", "config")).alias("config"),
        F.when(F.col("split") == "train", X.clean_text(X.cause_of_fault("answer"))).otherwise("").alias("cause"))


def _texts_sql() -> str:
    return (f"{split_sql(*_TEXT_INPUTS)}, t AS MATERIALIZED (SELECT report_id, target, split, {Q.clean_text('heading')} AS heading, {Q.clean_text(Q.section('observation', 'effect'))} AS effect, "
            f"{Q.clean_alphanum(Q.section('observation', 'config'))} AS config, CASE WHEN split = 'train' THEN {Q.clean_text(Q.cause_of_fault('answer'))} ELSE '' END AS cause FROM x)")


def _tokens_sql() -> str:
    """CTE tok: one row per token that is no stop word."""
    words = ", ".join(Q.quote(w) for w in english_stop_words())
    listed = " UNION ALL ".join(f"SELECT '{s}' AS section, report_id, split, {Q.tokens(s)} AS words FROM t" for s in SECTIONS)
    return (f"{_texts_sql()}, lists AS MATERIALIZED ({listed}), tok AS MATERIALIZED (SELECT * FROM (SELECT section, report_id, split, unnest(words) AS term, "
            f"generate_subscripts(words, 1) AS pos FROM lists) WHERE term NOT IN ({words}))")


def _vocabulary_sql(config: RunConfig) -> str:
    grams = config.budgets["ngram_max"]
    occurrences = "SELECT section, report_id, term FROM tok WHERE split = 'train'"
    if grams == 2:
        occurrences += (" UNION ALL SELECT section, report_id, term || ' ' || next FROM (SELECT *, lead(term) OVER (PARTITION BY section, report_id ORDER BY pos) AS next FROM tok "
                        "WHERE split = 'train') WHERE next IS NOT NULL")
    budgets = " ".join(f"WHEN '{s}' THEN {b}" for s, b in config.section_budgets().items())
    return (f"{_tokens_sql()}, occ AS ({occurrences}), g AS (SELECT section, term, count(*) AS total, count(DISTINCT report_id) AS docs FROM occ GROUP BY 1, 2), "
            f"nd AS (SELECT count(*) AS n_docs FROM t WHERE split = 'train'), "
            f"v AS (SELECT section, term, total, docs FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY total DESC, term) AS rk FROM g, nd "
            f"WHERE docs >= 2 AND docs <= 0.95 * n_docs) WHERE rk <= CASE section {budgets} END)")


@query("vocabulary", lambda: f"WITH {_vocabulary_sql(BALANCED)} SELECT section, term, total, docs FROM v")
def _vocabulary(spark, sf):
    train = checkpoint(section_texts(split_rows(spark, sf, *_TEXT_INPUTS)).filter("split = 'train'").select(*SECTIONS))
    n_docs, budgets = train.count(), BALANCED.section_budgets()
    counts = section_terms(train, {s: s for s in SECTIONS}, english_stop_words(), BALANCED.budgets["ngram_max"])
    counts = checkpoint(counts)                 # one top-k per section reads it
    out = None
    for s in SECTIONS:
        top = top_terms(counts, s, budgets[s], n_docs)
        out = top if out is None else out.unionByName(top)
    return out


def weights_sql() -> str:
    """CTEs up to w: TF-IDF weights (section, report_id, split, target, term, part, weight) of all sections: `part` is of length 1
    per section, `weight` per report."""
    return (f"{_vocabulary_sql(FAST)}, tf AS (SELECT section, report_id, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3), "
            "u AS (SELECT tf.section, tf.report_id, tf.term, tf * (ln((1.0 + n_docs) / (1.0 + docs)) + 1) AS raw FROM tf JOIN v ON v.term = tf.term AND v.section = tf.section, nd), "
            "p AS (SELECT section, report_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY report_id, section)) AS part FROM u), "
            "w AS MATERIALIZED (SELECT p.section, p.report_id, t.split, t.target, term, part, part / sqrt(sum(part * part) OVER (PARTITION BY p.report_id)) AS weight FROM p JOIN t ON t.report_id = p.report_id)")


def fitted_sections(spark, sf, config: RunConfig = FAST):
    """Split rows with the unit TF-IDF vector of every section (tfidf_<section>), and the vocabularies."""
    rows = checkpoint(section_texts(split_rows(spark, sf, *_TEXT_INPUTS)))
    models, _ = fit_section_tfidf(rows.filter("split = 'train'"), {s: s for s in SECTIONS}, config.section_budgets(), config.budgets["ngram_max"])
    for section in SECTIONS:
        rows = models[section].transform(rows)
    return rows.select("report_id", "target", "split", *[f"tfidf_{s}" for s in SECTIONS]), {s: models[s].stages[1].vocabulary for s in SECTIONS}


def text_vectors(spark, sf, config: RunConfig = FAST):
    """(report_id, target, split, terms, weights): all sections side by side as one unit vector."""
    rows, vocabularies = fitted_sections(spark, sf, config)
    sizes = [len(vocabularies[s]) for s in SECTIONS]
    terms, weights = sparse_unit([(f"tfidf_{s}", sum(sizes[:i])) for i, s in enumerate(SECTIONS)])
    return rows.select("report_id", "target", "split", terms.alias("terms"), weights.alias("weights"))


def long_weights(rows, vocabularies: dict[str, list[str]], *keep: str):
    """(keep..., section, term, weight) of the sections' sparse vectors. Terms come from a table that the vocabularies' budgets bound."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(s, i, t) for s, words in vocabularies.items() for i, t in enumerate(words)], "section string, i int, term string")

    def cells(section):
        v = F.unwrap_udt(f"tfidf_{section}")
        return F.transform(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("weight")), lambda e: F.struct(F.lit(section).alias("section"), e["i"].alias("i"), e["weight"].alias("weight")))

    return rows.select(*keep, F.inline(F.concat(*map(cells, vocabularies)))).join(F.broadcast(names), ["section", "i"]).drop("i")


@query("tfidf_topterms", lambda: f"WITH {weights_sql()} SELECT report_id, section, rank, term, round(part, 6) AS weight FROM "
       "(SELECT *, row_number() OVER (PARTITION BY report_id, section ORDER BY round(part, 9) DESC, term) AS rank FROM w) WHERE rank <= 5")
def _topterms(spark, sf):
    rows, vocabularies = fitted_sections(spark, sf)
    weights = long_weights(rows, vocabularies, "report_id")
    top = best_k(weights, ["report_id", "section"], 5, F.desc(F.round("weight", 9)), F.col("term"))
    return top.select("report_id", "section", "rank", "term", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- scaling and encoding
_SCALED = ["priority_ordinal", *S.NUMERIC_SIGNALS]
_VIEW = [*S.SIGNAL_INPUTS, "priority"]
_RAW_SIGNALS = {**Q.SIGNALS, "log_routing_time": "ln(1 + coalesce(routing_time, 0))",
                "waiting_ratio": "CASE WHEN coalesce(total_routing_time, 0) + 1 = 0 THEN 0 ELSE coalesce(routing_waiting_time, 0) / (coalesce(total_routing_time, 0) + 1) END"}


def _signal_rows(spark, sf):
    """Split rows with all signals as the feature pipeline sees them."""
    return ReportColumns().transform(split_rows(spark, sf, "heading", "answer", *_VIEW))


_SIGNAL_CTE = (f"{split_sql(*_VIEW)}, z AS (SELECT report_id, split, {Q.priority('priority')} AS priority_ordinal, " +
               ", ".join(f"{_RAW_SIGNALS[n]} AS {n}" for n in S.NUMERIC_SIGNALS) + " FROM x)")


@query("standard_scale", f"WITH {_SIGNAL_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END, 6)::DOUBLE AS scale FROM z WHERE split = 'train'" for c in _SCALED))
def _scale(spark, sf):
    train = _signal_rows(spark, sf).filter("split = 'train'").select(*_SCALED)
    return population_scale(train, _SCALED).withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


_SHOWN = ["day_of_week", "log_routing_time", "waiting_ratio", "flag_alarm"]


@query("scaled_values", f"WITH {_SIGNAL_CTE}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _SHOWN) +
       " FROM z WHERE split = 'train') SELECT report_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SHOWN) + " FROM z, m")
def _scaled(spark, sf):
    rows = checkpoint(_signal_rows(spark, sf).select("report_id", "split", *_SHOWN))
    model: ColumnScalerModel = fit_scaler(rows.filter("split = 'train'"), _SHOWN, NUMERIC)
    z = vector_to_array(F.col(NUMERIC))
    return model.transform(rows).select("report_id", *[F.round(z[i], 6).alias(c) for i, c in enumerate(_SHOWN)])


def _named(field: str, names):
    return lambda i: F.struct(F.lit(field).alias("field"), F.element_at(names, i + 1).alias("category"))


_HOT = ["superior_unit", "fault_type", "product_rstate", "improvement_type"]


@query("one_hot", f"WITH {split_sql(*_HOT)}, l AS (" + " UNION ALL ".join(f"SELECT report_id, split, '{c}' AS field, coalesce({c}, 'unknown') AS category FROM x" for c in _HOT) +
       ") SELECT report_id, field, category FROM l WHERE EXISTS (SELECT 1 FROM l t WHERE t.split = 'train' AND t.field = l.field AND t.category = l.category)")
def _one_hot(spark, sf):
    """The hot slots in long form; a category unseen in training has none."""
    from pyspark.ml import Pipeline
    rows = checkpoint(split_rows(spark, sf, *_HOT).fillna("unknown", _HOT).select("report_id", "split", *_HOT))
    model = Pipeline(stages=one_hot_stages(_HOT)).fit(rows.filter("split = 'train'"))
    slots = []
    for c, labels in zip(_HOT, model.stages[0].labelsArray):
        names = F.array(*[F.lit(v) for v in labels])
        hot = F.transform(F.unwrap_udt(f"hot_{c}")["indices"], _named(c, names))
        slots.append(hot)
    return model.transform(rows).select("report_id", F.inline(F.concat(*slots)))


@query("safe_label", f"""WITH {split_sql('superior_unit', 'product_rstate')}, k AS (SELECT DISTINCT coalesce(product_rstate, '__unknown__') AS v FROM x WHERE split = 'train' UNION SELECT '__unknown__'),
       c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM k)
       SELECT report_id, split, coalesce(c.i, (SELECT i FROM c WHERE v = '__unknown__')) AS product_rstate_index FROM x LEFT JOIN c ON c.v = coalesce(x.product_rstate, '__unknown__')""")
def _safe(spark, sf):
    rows = checkpoint(split_rows(spark, sf, "superior_unit", "product_rstate").select("report_id", "split", "product_rstate"))
    return safe_label(rows, "product_rstate").select("report_id", "split", "product_rstate_index")


@query("label_encode", f"WITH {split_sql()}, c AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS i FROM (SELECT DISTINCT target FROM x WHERE split = 'train')) SELECT report_id, i AS target_index FROM x JOIN c ON c.target = x.target")
def _strict(spark, sf):
    rows = checkpoint(split_rows(spark, sf).select("report_id", "split", "target"))
    return safe_label(rows, "target", "raise").select("report_id", "target_index")
