"""TF-IDF per text section: vocabulary by counting, then Spark ML stages for the transform."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import english_stop_words
from ..functions.text import tokens, with_ngrams

MIN_DOCS = 2
MAX_SHARE = 0.95
EMPTY_TEXT = "empty"


def token_columns(df: DataFrame, texts: dict[str, str], stop_words, ngram_max: int = 1) -> DataFrame:
    """Adds token columns {output: text column}. The stop words are a parameter of Spark's own remover,
    so the plan does not carry hundreds of literals."""
    raw = {out: f"_raw_{out}" for out in texts}
    df = df.withColumns({raw[out]: tokens(text) for out, text in texts.items()})
    if stop_words:
        df = StopWordsRemover(inputCols=list(raw.values()), outputCols=list(raw), stopWords=stop_words, caseSensitive=True).transform(df)
    else:
        df = df.withColumns({out: F.col(r) for out, r in raw.items()})
    df = df.drop(*raw.values())
    return df.withColumns({out: with_ngrams(out, ngram_max) for out in raw}) if ngram_max > 1 else df


class Tokens(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Token array of a text column."""

    inputCol = Param(Params._dummy(), "inputCol", "text column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "token column", TypeConverters.toString)
    stopWords = Param(Params._dummy(), "stopWords", "words left out", TypeConverters.toListString)
    ngramMax = Param(Params._dummy(), "ngramMax", "longest n-gram", TypeConverters.toInt)

    def __init__(self, inputCol=None, outputCol=None, stopWords=None, ngramMax=1):
        super().__init__()
        self._setDefault(stopWords=[], ngramMax=1)
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol, stopWords=stopWords or [], ngramMax=ngramMax)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        return token_columns(df, {get("outputCol"): get("inputCol")}, get("stopWords"), get("ngramMax"))


def term_counts(df: DataFrame, token_cols: dict[str, str]) -> DataFrame:
    """(section, term, total, docs) over all sections in one pass and one shuffle.

    A row gives each token once for the total and each distinct token once for the document count;
    both sums combine map-side, which also takes care of very frequent terms."""
    def marked(section, words, first):
        return F.transform(words, lambda w: F.struct(F.lit(section).alias("section"), w.alias("term"), F.lit(first).alias("first")))

    all_terms = F.concat(*[marked(s, words, first) for s, c in token_cols.items()
                           for words, first in ((F.col(c), 0), (F.array_distinct(c), 1))])
    return (df.select(F.inline(all_terms)).groupBy("section", "term")
            .agg(F.sum(1 - F.col("first")).alias("total"), F.sum("first").alias("docs")))


def section_terms(df: DataFrame, text_columns: dict[str, str], stop_words, ngram_max: int = 1) -> DataFrame:
    names = {f"_words_{s}": c for s, c in text_columns.items()}
    return term_counts(token_columns(df.select(*text_columns.values()), names, stop_words, ngram_max), {s: f"_words_{s}" for s in text_columns})


def top_terms(counts: DataFrame, section: str, budget: int, n_docs: int, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Terms within the document-frequency limits, most frequent first, ties by term; a top-k."""
    return (counts.filter((F.col("section") == section) & (F.col("docs") >= min_docs) & (F.col("docs") <= max_share * n_docs))
            .orderBy(F.desc("total"), "term").limit(budget))


def idf(docs, n_docs):
    return F.log((1.0 + n_docs) / (1.0 + docs)) + 1.0


def _section_model(rows, n_docs: int, text: str, section: str, stop_words, ngram_max: int) -> PipelineModel:
    import math
    rows = sorted(rows, key=lambda r: r.term)
    weights = [math.log((1.0 + n_docs) / (1.0 + r.docs)) + 1.0 for r in rows]
    t, c, w, out = f"_{section}_tokens", f"_{section}_counts", f"_{section}_weighted", f"tfidf_{section}"
    return PipelineModel([
        Tokens(text, t, stop_words, ngram_max),
        CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol=t, outputCol=c),
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=c, outputCol=w),
        Normalizer(p=2.0, inputCol=w, outputCol=out),
    ])


def fit_section_tfidf(train: DataFrame, text_columns: dict[str, str], budgets: dict[str, int], ngram_max: int = 1,
                      stop_words: list[str] | None = None) -> tuple[dict[str, PipelineModel], dict[str, int]]:
    """One fitted TF-IDF pipeline per section, and its vocabulary sizes. Only the vocabularies (at
    most the budgets) come to the driver.

    A section whose vocabulary is empty is refitted without stop words, on single words and without
    document-frequency limits; blank texts then count as the word 'empty'."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    n_docs = train.count()
    counts = section_terms(train, text_columns, stop_words, ngram_max).persist()
    models, sizes = {}, {}
    try:
        found = {s: top_terms(counts, s, budgets[s], n_docs).collect() for s in text_columns}
    finally:
        counts.unpersist()
    for section, column in text_columns.items():
        rows, words, grams = found[section], stop_words, ngram_max
        if not rows:
            words, grams = [], 1
            filled = F.when(F.coalesce(F.col(column), F.lit("")) == "", EMPTY_TEXT).otherwise(F.col(column))
            plain = section_terms(train.select(filled.alias("_text")), {section: "_text"}, [])
            rows = top_terms(plain, section, budgets[section], n_docs, 1, 1.0).collect()
            if not rows:
                raise ValueError(f"no words at all in section {section!r}")
        models[section] = _section_model(rows, n_docs, column, section, words, grams)
        sizes[section] = len(rows)
    return models, sizes
