"""Feature pipeline: one fitted PipelineModel from report columns to the vectors text_vec and full_vec."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.signals import CATEGORICAL_SIGNALS, NUMERIC_SIGNALS, UNKNOWN, priority_ordinal, signals
from ..functions.text import cause_of_fault, clean_alphanum, clean_text, effect_or_full, joined_words, section
from ..sources.columns import SCORING_COLUMNS, ensure_columns
from .vocabulary import fit_section_tfidf

SECTIONS = ("heading", "effect", "config", "cause")
FEATURE_SETS = {"TF-IDF only": "text_vec", "TF-IDF + All": "full_vec"}
NUMERIC = "numeric_vec"
PRIORITY = "priority_vec"


def feature_column(feature_set: str) -> str:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; use one of {sorted(FEATURE_SETS)}")
    return FEATURE_SETS[feature_set]


class ReportColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Section texts and signals of a report, nulls filled. The cause of fault is known only after a
    report is solved, so it is read from rows with split = 'train' and blank for all others."""

    dashDates = Param(Params._dummy(), "dashDates", "accept 'date - time'", TypeConverters.toBoolean)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "raw categorical columns", TypeConverters.toListString)

    def __init__(self, dashDates=True, categoricalCols=("superior_unit", "fault_type")):
        super().__init__()
        self._set(dashDates=dashDates, categoricalCols=list(categoricalCols))

    def _transform(self, df: DataFrame) -> DataFrame:
        raw = self.getOrDefault("categoricalCols")
        df = ensure_columns(df, {**SCORING_COLUMNS, **{c: "string" for c in raw}})
        cause = clean_text(cause_of_fault("answer"))
        if "split" in df.columns:
            cause = F.when(F.col("split") == "train", cause).otherwise("")
        else:
            cause = F.lit("")
        texts = [clean_text("heading").alias("text_heading"), clean_text(section("observation", "effect")).alias("text_effect"),
                 clean_alphanum(section("observation", "config")).alias("text_config"), cause.alias("text_cause"),
                 clean_text(effect_or_full("observation")).alias("text_effect_full")]
        out = df.select("*", *texts, *signals(self.getOrDefault("dashDates")),
                        priority_ordinal("priority").cast("double").alias("priority_ordinal"))
        # an infinite value (total routing time -1) has no scaled form and counts as missing
        finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("waiting_ratio", "log_routing_time")}
        return out.withColumns(finite).fillna(UNKNOWN, [*raw, *CATEGORICAL_SIGNALS]).fillna(0, NUMERIC_SIGNALS)


class ColumnScalerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population standard deviation for a few columns, as one vector."""

    inputCols = Param(Params._dummy(), "inputCols", "numeric columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "column scales", TypeConverters.toListFloat)

    def __init__(self, inputCols=None, outputCol=None, means=None, scales=None):
        super().__init__()
        if inputCols:
            self._set(inputCols=inputCols, outputCol=outputCol, means=means, scales=scales)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        temp = [f"_z{i}" for i in range(len(get("inputCols")))]
        scaled = [((F.col(c) - m) / s).alias(t) for c, m, s, t in zip(get("inputCols"), get("means"), get("scales"), temp)]
        return VectorAssembler(inputCols=temp, outputCol=get("outputCol")).transform(df.select("*", *scaled)).drop(*temp)


def population_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, mean, scale) of each column: population standard deviation, 1 where it is 0."""
    sums = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"m_{c}").alias("mean"),
                     F.when(F.col(f"s_{c}") < 1e-12, 1.0).otherwise(F.col(f"s_{c}")).alias("scale")) for c in columns]
    return sums.select(F.inline(F.array(*rows)))


def fit_scaler(df: DataFrame, columns: list[str], output: str) -> ColumnScalerModel:
    found = {r.field: r for r in population_scale(df, columns).collect()}       # one row per column
    return ColumnScalerModel(columns, output, [float(found[c].mean or 0.0) for c in columns], [float(found[c].scale or 1.0) for c in columns])


def one_hot_stages(columns: list[str]) -> list:
    """Sorted categories; a value unseen in training gives an all-zero block."""
    index, hot = [f"_{c}_index" for c in columns], [f"hot_{c}" for c in columns]
    return [StringIndexer(inputCols=columns, outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]


def fit_features(train: DataFrame, config: RunConfig = RunConfig(), embedding: str | None = None) -> tuple[PipelineModel, dict]:
    """Fit on the training rows; returns the pipeline and its metadata.

    Blocks: text_vec = heading | effect | config | cause, full_vec = text (| embedding) | priority |
    categorical | numeric | engineered categorical. `embedding` names a vector column, if there is one."""
    rows = prepared_columns(train.withColumn("split", F.lit("train")), config).persist()
    try:
        return fit_prepared(rows, config, embedding)
    finally:
        rows.unpersist()


def prepared_columns(df: DataFrame, config: RunConfig, *keep: str) -> DataFrame:
    """What the stages after ReportColumns read, beside the kept columns."""
    raw_cats = list(config.categorical_columns)
    return ReportColumns(not config.strict_dates, raw_cats).transform(df).select(
        *keep, *[f"text_{s}" for s in SECTIONS], *raw_cats, *CATEGORICAL_SIGNALS, *NUMERIC_SIGNALS, "priority_ordinal")


def fit_prepared(rows: DataFrame, config: RunConfig = RunConfig(), embedding: str | None = None) -> tuple[PipelineModel, dict]:
    """`fit_features` on the prepared columns of the training rows; they are read several times."""
    raw_cats = list(config.categorical_columns)
    prepare = ReportColumns(not config.strict_dates, raw_cats)
    tfidf, sizes = fit_section_tfidf(rows, {s: f"text_{s}" for s in SECTIONS}, config.section_budgets(), config.budgets["ngram_max"])
    scalers = [fit_scaler(rows, ["priority_ordinal"], PRIORITY), fit_scaler(rows, NUMERIC_SIGNALS, NUMERIC)]
    hot = Pipeline(stages=one_hot_stages(raw_cats + CATEGORICAL_SIGNALS)).fit(rows)
    hot_raw, hot_new = [f"hot_{c}" for c in raw_cats], [f"hot_{c}" for c in CATEGORICAL_SIGNALS]
    text_blocks = [f"tfidf_{s}" for s in SECTIONS]
    extra = [embedding] if embedding else []
    join = lambda cols, out: VectorAssembler(inputCols=cols, outputCol=out)
    stages = [prepare, *[tfidf[s] for s in SECTIONS], *scalers, hot,
              join(text_blocks, "text_vec"), join(hot_raw, "categorical_vec"), join(hot_new, "engineered_cat_vec"),
              join(["text_vec", *extra, PRIORITY, "categorical_vec", NUMERIC, "engineered_cat_vec"], "full_vec")]
    widths = [len(labels) for labels in hot.stages[0].labelsArray]
    metadata = {
        "tfidf_sections": sizes, "text_width": sum(sizes.values()), "priority_width": 1,
        "categorical_width": sum(widths[:len(raw_cats)]), "numeric_width": len(NUMERIC_SIGNALS),
        "engineered_cat_width": sum(widths[len(raw_cats):]), "feature_sets": list(FEATURE_SETS),
    }
    metadata["full_width"] = sum(v for k, v in metadata.items() if k.endswith("_width"))
    return PipelineModel(stages), metadata


BLOCKS = ("text_vec", PRIORITY, "categorical_vec", NUMERIC, "engineered_cat_vec")


def featurise(df: DataFrame, model: PipelineModel, *keep: str) -> DataFrame:
    """Vectors of every block beside the kept columns; token and text helpers are dropped."""
    return model.transform(df).select(*keep, *BLOCKS, "full_vec")


def label_indexer(train: DataFrame, label: str = "target", output: str = "label_index"):
    """Strict label encoder: sorted classes, unseen labels are an error."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="error").fit(train)


UNKNOWN_LABEL = "__unknown__"


def safe_label(df: DataFrame, column: str, strategy: str = "warn", split: str = "split") -> DataFrame:
    """Adds `<column>_index` over the sorted training values. With 'warn', null and unseen values map
    to '__unknown__', which always is a class; with 'raise', an unseen value fails the query."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN_LABEL))
    known = df.filter(F.col(split) == "train").select(value.alias("_value")).distinct()
    if strategy == "warn":
        known = known.union(df.sparkSession.range(1).select(F.lit(UNKNOWN_LABEL))).distinct()
    elif strategy != "raise":
        raise ValueError("strategy must be 'warn' or 'raise'")
    classes = known.agg(F.array_sort(F.collect_list("_value"))).scalar()     # the class list of the encoder
    out = df.withColumns({"_classes": classes, "_value": value})
    position = F.array_position("_classes", F.col("_value"))
    if strategy == "raise":
        position = F.when(position > 0, position).otherwise(F.raise_error(F.concat(F.lit("unseen label: "), F.col("_value"))).cast("long"))
    else:
        position = F.when(position > 0, position).otherwise(F.array_position("_classes", F.lit(UNKNOWN_LABEL)))
    return out.withColumn(f"{column}_index", (position - 1).cast("long")).drop("_classes", "_value")


def cumulative_texts(df: DataFrame) -> DataFrame:
    """The three growing texts of forward selection."""
    return df.withColumns({
        "step_heading": F.col("text_heading"),
        "step_effect": joined_words("text_heading", "text_effect_full"),
        "step_cause": joined_words("text_heading", "text_effect_full", "text_cause"),
    })


def encode_texts(df: DataFrame, text: str, encoder, output: str = "embedding") -> DataFrame:
    """Hook for a sentence encoder: `encoder` maps a list of texts to a list of float lists and runs
    inside the tasks, one Arrow batch at a time."""
    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encoder(texts.fillna("").tolist())])

    return df.withColumn(output, encode(text))
