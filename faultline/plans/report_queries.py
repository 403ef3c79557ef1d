"""Queries over the report view: texts, signals, preparation, profiles and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X
from ..operators import prepare as P
from ..operators import profile as R
from ..operators import splits as L
from ..session import checkpoint
from . import sql as Q
from .report_view import REPORT_COLUMNS, reports, reports_sql, table

QUERIES, SQL = {}, {}
MIN_SAMPLES = 20          # the benchmark classes are small; the default of the library is 100
TEXT_COLUMNS = ["heading", "observation", "answer"]
CATEGORIES = ["priority", "superior_unit", "fault_type", "analysis_fault_type", "improvement_type"]
TIMES = ["routing_time", "routing_waiting_time", "total_routing_time", "total_time"]
FLAGS = list(S.FLAG_PATTERNS)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def _rows(name: str, columns: list[str], exprs: dict, sql_exprs: dict):
    """A row-wise query: report columns in, named expressions out."""
    view = reports_sql("ingest_pos", *columns)
    listed = ", ".join(f"{e} AS {n}" for n, e in sql_exprs.items())
    SQL[name] = f"WITH r AS ({view}) SELECT ingest_pos, {listed} FROM r"
    QUERIES[name] = lambda spark, sf: reports(spark, sf, "ingest_pos", *columns).select("ingest_pos", *[e().alias(n) for n, e in exprs.items()])


def round6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- texts
_rows("clean_text", ["observation"], {"cleaned": lambda: X.clean_text("observation")}, {"cleaned": Q.clean_text("observation")})
_rows("clean_alnum", ["observation"], {"cleaned": lambda: X.clean_alphanum("observation")}, {"cleaned": Q.clean_alphanum("observation")})
_rows("effect_or_full", ["observation"], {"effect": lambda: X.effect_or_full("observation")}, {"effect": Q.effect_or_full("observation")})
_rows("sections", ["observation"], {n: (lambda n=n: X.section("observation", n)) for n in X.SECTION_PATTERNS},
      {n: Q.section("observation", n) for n in X.SECTION_PATTERNS})
_rows("cause_of_fault", ["answer"], {"cause": lambda: X.cause_of_fault("answer")}, {"cause": Q.cause_of_fault("answer")})
_rows("combined_text", TEXT_COLUMNS, {"combined": lambda: X.combined_text("heading", "observation", "answer")},
      {"combined": Q.combined_text("heading", "observation", "answer")})
_rows("joined_words", ["heading", "answer"], {"words": lambda: X.joined_words(X.clean_text("heading"), X.clean_text("answer"))},
      {"words": f"{Q.clean_text('heading')} || ' ' || {Q.clean_text('answer')}"})
_rows("word_count", ["observation"], {"words": lambda: X.word_count("observation").cast("long")}, {"words": Q.word_count("observation")})

# ---------------------------------------------------------------- signals
_rows("keyword_flags", ["observation"], {n: (lambda n=n: S.flag("observation", n)) for n in FLAGS}, {n: Q.SIGNALS[n] for n in FLAGS})
_rows("board_release", ["observation"], {"board_type": lambda: S.first_match("observation", S.BOARD_PATTERN), "sw_release": lambda: S.first_match("observation", S.RELEASE_PATTERN)},
      {n: Q.SIGNALS[n] for n in ("board_type", "sw_release")})
_DATE_PARTS = ["hour_of_day", "day_of_week", "reg_quarter", "reg_year"]
_rows("temporal_features", ["registered"], {n: (lambda i=i: S.date_parts("registered")[i]) for i, n in enumerate(_DATE_PARTS)},
      {n: Q.SIGNALS[n] for n in _DATE_PARTS})
_ROUTING = ["log_routing_time", "waiting_ratio", "auto_routed", "is_duplicate"]
_rows("routing_features", ["routing_time", "routing_waiting_time", "total_routing_time", "routed", "is_duplicate_report"],
      {"log_routing_time": lambda: round6(S.log_time("routing_time")), "waiting_ratio": lambda: round6(S.waiting_ratio("routing_waiting_time", "total_routing_time")),
       "auto_routed": lambda: S.is_true("routed"), "is_duplicate": lambda: S.is_true("is_duplicate_report")},
      {n: Q.SIGNALS[n] for n in _ROUTING})
_rows("dup_id_count", ["duplicate_reports"], {"num_duplicates": lambda: S.duplicate_id_count("duplicate_reports")}, {"num_duplicates": Q.SIGNALS["num_duplicates"]})
_rows("rstate", ["product_rstate"], {"rstate_major": lambda: S.rstate_major("product_rstate")}, {"rstate_major": Q.SIGNALS["rstate_major"]})
_rows("cross_component", ["product_no", "node_product_no"], {"cross_component": lambda: S.cross_component("product_no", "node_product_no")},
      {"cross_component": Q.SIGNALS["cross_component"]})
_rows("catalog_join", ["product_no"], {n: (lambda n=n: S.product_info("product_no")[n]) for n in ("prod_family", "prod_gen", "prod_tech")},
      {n: Q.SIGNALS[n] for n in ("prod_family", "prod_gen", "prod_tech")})
_rows("alarm_rules", ["observation"], {n: (lambda n=n: S.alarm_info("observation")[n]) for n in ("alarm_category", "alarm_severity")},
      {n: Q.SIGNALS[n] for n in ("alarm_category", "alarm_severity")})
_rows("priority_ordinal", ["priority"], {"priority_ordinal": lambda: S.priority_ordinal("priority")}, {"priority_ordinal": Q.priority("priority")})

_SIGNAL_NAMES = S.NUMERIC_SIGNALS + S.CATEGORICAL_SIGNALS
_SIGNAL_VIEW = reports_sql("ingest_pos", *S.SIGNAL_INPUTS)


def _signals(spark, sf):
    return reports(spark, sf, "ingest_pos", *S.SIGNAL_INPUTS).select("ingest_pos", *S.signals())


@query("engineered_features", f"WITH r AS ({_SIGNAL_VIEW}) SELECT ingest_pos, {Q.select(_SIGNAL_NAMES)} FROM r")
def _engineered(spark, sf):
    return _signals(spark, sf).withColumns({n: round6(n) for n in ("log_routing_time", "waiting_ratio")})


# ---------------------------------------------------------------- preparation
_KEYS = ["ingest_pos", "report_id", "team"]
FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ingest_pos) AS rn FROM r) WHERE rn = 1"


def prepared_sql(*columns: str) -> str:
    """CTEs r (view), f (first rows), s (supervised rows with target)."""
    view = reports_sql(*dict.fromkeys([*_KEYS, *columns]))
    return (f"r AS ({view}), f AS ({FIRST}), n AS (SELECT team, count(*) AS n FROM f WHERE team IS NOT NULL GROUP BY team), "
            f"s AS (SELECT f.*, CASE WHEN n.n >= {MIN_SAMPLES} THEN f.team ELSE 'other' END AS target FROM f JOIN n ON f.team = n.team)")


def prepared(spark, sf, *columns: str):
    return P.prepare_supervised(reports(spark, sf, *dict.fromkeys([*_KEYS, *columns])), MIN_SAMPLES)


@query("dedup_first", f"WITH r AS ({reports_sql(*_KEYS)}) SELECT ingest_pos, report_id, team FROM ({FIRST})")
def _dedup(spark, sf):
    return P.keep_first(reports(spark, sf, *_KEYS))


@query("rare_drop", f"WITH {prepared_sql()} SELECT r.ingest_pos, r.team AS target FROM r JOIN (SELECT team FROM r WHERE team IS NOT NULL GROUP BY team HAVING count(*) >= {MIN_SAMPLES}) k ON r.team = k.team")
def _rare_drop(spark, sf):
    return P.drop_rare(reports(spark, sf, "ingest_pos", "team"), "team", MIN_SAMPLES).select("ingest_pos", "target")


@query("rare_merge", f"WITH {prepared_sql()} SELECT r.ingest_pos, CASE WHEN k.team IS NULL THEN 'other' ELSE r.team END AS target FROM (SELECT * FROM r WHERE team IS NOT NULL) r "
       f"LEFT JOIN (SELECT team FROM r WHERE team IS NOT NULL GROUP BY team HAVING count(*) >= {MIN_SAMPLES}) k ON r.team = k.team")
def _rare_merge(spark, sf):
    return P.merge_rare(reports(spark, sf, "ingest_pos", "team").filter("team is not null"), "team", MIN_SAMPLES).select("ingest_pos", "target")


@query("prepare_supervised", f"WITH {prepared_sql()} SELECT ingest_pos, report_id, team, target FROM s")
def _prepare(spark, sf):
    return prepared(spark, sf)


@query("prep_report", f"""WITH {prepared_sql()} SELECT (SELECT count(*) FROM r) AS rows_before, (SELECT count(*) FROM f) AS rows_after_dedup,
       (SELECT count(*) FROM f WHERE team IS NULL) AS null_targets, (SELECT count(*) FROM s) AS rows_labelled,
       (SELECT count(*) FROM n) AS classes_before, (SELECT count(*) FROM n WHERE n.n < {MIN_SAMPLES}) AS rare_classes,
       (SELECT coalesce(sum(n.n), 0)::BIGINT FROM n WHERE n.n < {MIN_SAMPLES}) AS rare_rows, (SELECT count(DISTINCT target) FROM s) AS classes_merged""")
def _report(spark, sf):
    return P.preparation_report(reports(spark, sf, *_KEYS), MIN_SAMPLES)


@query("prepared_flags", f"WITH {prepared_sql('observation')} SELECT target, count(*) AS n_rows, " +
       ", ".join(f"sum({Q.SIGNALS[n]})::BIGINT AS {n}" for n in FLAGS) + " FROM s GROUP BY target")
def prepared_flags(spark, sf):
    """Signals per class of the supervised frame: the smallest end-to-end plan."""
    df = prepared(spark, sf, "observation")
    return df.select("target", *S.flags("observation")).groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(n).alias(n) for n in FLAGS])


# ---------------------------------------------------------------- profiles
_PROFILE_TYPES = {
    **{c: "string" for c in REPORT_COLUMNS}, "ingest_pos": "bigint", "routing_time": "double", "routing_waiting_time": "double",
    "total_routing_time": "double", "total_time": "double", "routed": "boolean", "is_duplicate_report": "boolean", "register_date": "date",
}


@query("null_profile", f"WITH r AS ({reports_sql()}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_pct FROM r" for c, t in _PROFILE_TYPES.items()))
def _null_profile(spark, sf):
    return R.null_profile(reports(spark, sf))


_PREVIEW = ["report_id", "team", "priority", "heading", "is_duplicate_report", "primary_report", "duplicate_reports", "superior_unit", "fault_type", "analysis_fault_type"]


@query("preview", f"SELECT * FROM ({reports_sql('ingest_pos', *_PREVIEW)}) ORDER BY ingest_pos LIMIT 10")
def _preview(spark, sf):
    return R.preview(reports(spark, sf, "ingest_pos", *_PREVIEW), _PREVIEW)


@query("target_profile", f"WITH r AS ({reports_sql('team')}) SELECT count(*) AS n_rows, count(DISTINCT team) AS n_classes, count(*) - count(team) AS null_rows FROM r")
def _target(spark, sf):
    return R.target_profile(reports(spark, sf, "team"), "team")


def _top_sql(view: str, column: str, k: int | None) -> str:
    tail = f" ORDER BY n_rows DESC, value LIMIT {k}" if k else ""
    return f"WITH r AS ({view}) SELECT {column} AS value, count(*) AS n_rows FROM r WHERE {column} IS NOT NULL GROUP BY 1{tail}"


@query("top_labels", _top_sql(reports_sql("team"), "team", 20))
def _top(spark, sf):
    return R.top_values(reports(spark, sf, "team"), "team")


@query("class_distribution", f"WITH {prepared_sql()} SELECT target AS value, count(*) AS n_rows FROM s GROUP BY 1")
def _distribution(spark, sf):
    return R.top_values(prepared(spark, sf), "target", None)


def _bins_sql() -> str:
    edges = R.CLASS_SIZE_EDGES
    ends = [str(e) for e in edges[1:]] + ["(SELECT max(n) + 1 FROM c)"]
    rows = " UNION ALL ".join(f"SELECT {lo}::BIGINT AS size_from, {hi}::BIGINT AS size_below, (SELECT count(*) FROM c WHERE n >= {lo} AND n < {hi}) AS n_classes" for lo, hi in zip(edges, ends))
    return f"WITH r AS ({reports_sql('team')}), c AS (SELECT team, count(*) AS n FROM r WHERE team IS NOT NULL GROUP BY team) {rows}"


@query("class_size_bins", _bins_sql())
def _bins(spark, sf):
    return R.class_size_bins(reports(spark, sf, "team"), "team")


_LONG_WORDS = " UNION ALL ".join(f"SELECT '{c}' AS field, {Q.word_count(c)} AS words, {c} IS NULL AS missing FROM r" for c in TEXT_COLUMNS)


@query("word_stats", f"WITH r AS ({reports_sql(*TEXT_COLUMNS)}), w AS ({_LONG_WORDS}) SELECT field, round(avg(words), 6) AS mean_words, "
       "quantile_cont(words, 0.5)::DOUBLE AS median_words, max(words) AS max_words, round(avg(missing::INTEGER) * 100, 6) AS null_pct FROM w GROUP BY field")
def _word_stats(spark, sf):
    return R.word_stats(reports(spark, sf, *TEXT_COLUMNS), TEXT_COLUMNS).withColumns({c: round6(c) for c in ("mean_words", "null_pct")})


@query("word_hist", f"""WITH r AS ({reports_sql(*TEXT_COLUMNS)}), w AS ({_LONG_WORDS}),
       c AS (SELECT field, floor(quantile_cont(words, 0.95)) AS cap FROM w GROUP BY field),
       x AS (SELECT w.field, least(words, cap) AS v, cap FROM w JOIN c ON w.field = c.field),
       e AS (SELECT field, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM x GROUP BY field)
       SELECT x.field, least(floor((v - lo) / (hi - lo) * 40), 39)::INTEGER AS bin, count(*) AS n_rows, max(cap)::BIGINT AS cap FROM x JOIN e ON x.field = e.field GROUP BY 1, 2""")
def _word_hist(spark, sf):
    return R.word_histogram(reports(spark, sf, *TEXT_COLUMNS), TEXT_COLUMNS)


def _long_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM r" for c in columns)


@query("cat_distributions", f"WITH r AS ({reports_sql(*CATEGORIES)}), l AS ({_long_sql(CATEGORIES)}) SELECT field, value, count(*) AS n_rows FROM l WHERE value IS NOT NULL GROUP BY 1, 2")
def _categories(spark, sf):
    return R.value_distributions(reports(spark, sf, *CATEGORIES), CATEGORIES)


@query("cat_cardinality", f"WITH r AS ({reports_sql(*CATEGORIES)}), l AS ({_long_sql(CATEGORIES)}) SELECT field, count(DISTINCT value) AS n_unique, count(*) AS n_rows, count(*) - count(value) AS null_rows FROM l GROUP BY 1")
def _cardinality(spark, sf):
    return R.value_cardinality(reports(spark, sf, *CATEGORIES), CATEGORIES)


@query("dup_rate", f"WITH r AS ({reports_sql('is_duplicate_report')}) SELECT count(*) AS n_rows, count(*) FILTER (is_duplicate_report) AS n_true, "
       "count(*) FILTER (NOT is_duplicate_report) AS n_false, round(count(*) FILTER (is_duplicate_report) * 100.0 / count(*), 6)::DOUBLE AS pct_true FROM r")
def _dup_rate(spark, sf):
    return R.share_true(reports(spark, sf, "is_duplicate_report"), "is_duplicate_report").withColumn("pct_true", round6("pct_true"))


@query("date_range", f"WITH r AS ({reports_sql('registered')}), t AS (SELECT {Q.parsed_time('registered')} AS ts FROM r) SELECT min(ts) AS first_date, max(ts) AS last_date, count(ts) AS n_dated FROM t")
def _date_range(spark, sf):
    return R.date_range(reports(spark, sf, "registered").select(S.parse_time("registered").alias("ts")), F.col("ts"))


@query("monthly_volume", f"WITH r AS ({reports_sql('register_date')}) SELECT strftime(register_date, '%Y-%m') AS month, count(*) AS n_rows FROM r WHERE register_date IS NOT NULL GROUP BY 1")
def _monthly(spark, sf):
    return R.monthly_volume(reports(spark, sf, "register_date"), F.col("register_date"))


def _describe_sql(view: str, columns: list[str]) -> str:
    return f"WITH r AS ({view}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 6)::DOUBLE AS min, "
        f"round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q25, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS q50, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q75, round(max({c}), 6)::DOUBLE AS max FROM r" for c in columns)


def _rounded(df):
    return df.withColumns({**{c: F.round(c, 4) for c in ("mean", "std")}, **{c: round6(c) for c in ("min", "q25", "q50", "q75", "max")}})


@query("describe", _describe_sql(reports_sql(*TIMES), TIMES))
def _describe(spark, sf):
    return _rounded(R.describe(reports(spark, sf, *TIMES), TIMES))


@query("describe_lineitem", _describe_sql("SELECT * FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _describe_lineitem(spark, sf):
    """The same profile on the largest table."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _rounded(R.describe(table(spark, sf, "lineitem").select(*columns), columns))


_DESCRIBED = ["num_duplicates", "rstate_major", "hour_of_day", "log_routing_time"]


@query("describe_features", _describe_sql(f"SELECT {Q.select(_DESCRIBED)} FROM ({reports_sql(*S.SIGNAL_INPUTS)})", _DESCRIBED))
def _describe_features(spark, sf):
    return _rounded(R.describe(_signals(spark, sf).select(*_DESCRIBED), _DESCRIBED))


@query("flag_rates", f"WITH r AS ({reports_sql('observation')}) " + " UNION ALL ".join(f"SELECT '{n}' AS field, round(avg({Q.SIGNALS[n]}), 6) AS mean FROM r" for n in FLAGS))
def _flag_rates(spark, sf):
    return R.column_means(reports(spark, sf, "observation").select(*S.flags("observation")), FLAGS).withColumn("mean", round6("mean"))


for _name in ("board_type", "sw_release", "prod_family", "alarm_category", "alarm_severity"):
    _tops = 10 if _name in ("board_type", "sw_release") else None
    SQL[f"tops_{_name}"] = _top_sql(f"SELECT {Q.SIGNALS[_name]} AS v FROM ({_SIGNAL_VIEW})", "v", _tops)
    QUERIES[f"tops_{_name}"] = lambda spark, sf, n=_name, k=_tops: R.top_values(_signals(spark, sf).select(n), n, k)


# ---------------------------------------------------------------- splits
def split_sql(*columns: str) -> str:
    """CTEs up to x: supervised rows with their stratified split."""
    return (prepared_sql(*columns) + ", x AS MATERIALIZED (SELECT *, CASE WHEN rk <= floor(0.6 * c + 0.5) THEN 'train' WHEN rk <= floor(0.8 * c + 0.5) THEN 'val' ELSE 'test' END AS split FROM "
            "(SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(report_id || '|42')) AS rk, count(*) OVER (PARTITION BY target) AS c FROM s))")


def split_rows(spark, sf, *columns: str):
    """The split reads the supervised rows several times, so they are written once."""
    return L.stratified_split(checkpoint(prepared(spark, sf, *columns)))


@query("stratified_split", f"WITH {split_sql()} SELECT report_id, target, split FROM x")
def _stratified(spark, sf):
    return split_rows(spark, sf).select("report_id", "target", "split")


@query("temporal_split", f"""WITH {prepared_sql('registered')}, o AS (SELECT report_id, registered, row_number() OVER (ORDER BY {Q.parsed_time('registered')} NULLS LAST, md5(report_id || '|42')) AS rk, count(*) OVER () AS c FROM s)
       SELECT report_id, registered, CASE WHEN rk <= floor(c * 0.6 + 1e-9) THEN 'train' WHEN rk <= floor(c * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM o""")
def _temporal(spark, sf):
    return L.temporal_split(checkpoint(prepared(spark, sf, "registered"))).select("report_id", "registered", "split")


_CONTRACT = ["superior_unit", "fault_type", "priority", "product_rstate"]


@query("split_contract", f"WITH {split_sql(*_CONTRACT)}, v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, split, {c} AS value FROM x WHERE {c} IS NOT NULL" for c in _CONTRACT) +
       "), k AS (SELECT field, value, bool_or(split = 'train') AS known, list(split) AS splits FROM v GROUP BY field, value) SELECT field, unnest(splits) AS split, value FROM k WHERE NOT known")
def _contract(spark, sf):
    return L.split_contract(split_rows(spark, sf, *_CONTRACT), _CONTRACT)


@query("class_weights", f"WITH {prepared_sql()}, c AS (SELECT target, count(*) AS n_rows FROM s GROUP BY 1) SELECT target, n_rows, round((SELECT sum(n_rows) FROM c) / ((SELECT count(*) FROM c) * n_rows), 6)::DOUBLE AS weight FROM c")
def _weights(spark, sf):
    from ..operators.evaluation import class_weights
    return class_weights(prepared(spark, sf), "target").withColumn("weight", round6("weight"))
