"""A report table derived from the benchmark tables, once as DataFrame and once as plain SQL.

Every document becomes one report row. Texts, dates, numbers and labels come from the tables, so the
view grows with them. A plan names the source tables it needs; the others are not read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# What an event or product tells in words, so that flags, boards and alarm rules have something to find.
EVENT_PHRASES = {
    "error": "Cell disabled alarm, core dump after program restart.",
    "click": "SW Error raised, OFFLINE_ state seen in coli> output.",
    "purchase": "CPRI link Fault, cold start needed.",
    "view": "Synchronization lost, mutex held.",
    "signup": "upgrade to UP 12 failed.",
}
PRODUCT_NUMBERS = {
    "ECONOMY": "KDU 137 848/1", "SMALL": "KRC161842", "MEDIUM": "KRD 901 206/1", "PROMO": "KDU1370015/2", "LARGE": "XYZ 11/1",
}
BOARDS = {"ECONOMY": "BB6630 21.Q3", "SMALL": "IRU1649 22.Q1", "MEDIUM": "AIR6449 22.Q1.2", "PROMO": "RDSX2 20.Q4", "LARGE": "none"}
PRIORITIES = {"1-URGENT": "A", "2-HIGH": "B", "3-MEDIUM": "C", "4-NOT SPECIFIED": "D"}

SOURCES = {"labels": "doc_id", "events": "event_id", "orders": "o_orderkey", "part": "p_partkey"}

REPORT_COLUMNS = [
    "ingest_pos", "report_id", "team", "heading", "observation", "answer", "registered", "priority", "superior_unit",
    "fault_type", "routing_time", "routing_waiting_time", "total_routing_time", "total_time", "routed",
    "is_duplicate_report", "duplicate_reports", "product_rstate", "product_no", "node_product_no", "primary_report",
    "analysis_fault_type", "improvement_type", "register_date",
]


# Declared, so that opening a table does not start a job to read footers.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict[str, str], default: str = "NULL") -> str:
    q = lambda t: "'" + t.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"


def _expressions(ts: str) -> dict[str, str]:
    """SQL of every report column, valid in Spark and in DuckDB; `ts` formats the event time."""
    nl = "' || chr(10) || '"
    phrase = _case("event_type", EVENT_PHRASES, "'no event'")
    board = _case("p_type", BOARDS, "'unknown board'")
    product = _case("p_type", PRODUCT_NUMBERS)
    text = lambda c: f"CAST({c} AS STRING)"
    return {
        "ingest_pos": "doc_id",
        "report_id": "md5(text)",
        "team": "lang || '-' || CASE WHEN quality IS NULL THEN NULL ELSE event_type END",
        "heading": "p_name || ' ' || p_brand || ' fault of ' || lang",
        "observation": (
            f"CASE WHEN o_orderstatus = 'P' AND lang = 'fr' THEN NULL WHEN lang = 'de' THEN text ELSE "
            f"'1 EFFECT{nl}====={nl}' || text || '{nl}2 TROUBLE DESCRIPTION{nl}====={nl}' || {phrase} || "
            f"'{nl}2.2 Configuration Data{nl}---{nl}' || {board} || ' ' || p_brand || "
            f"'{nl}2.3 Logs{nl}' || {ts} || '{nl}3 MEASURES{nl}====={nl}Check ' || p_name || "
            f"'{nl}4 CSR{nl}====={nl}' || o_orderpriority END"),
        "answer": (
            f"CASE o_orderstatus WHEN 'F' THEN 'Analysis{nl}CAUSE OF FAULT{nl}----------{nl}' || {phrase} || ' Unit ' || p_name || "
            f"'{nl}----------{nl}Closed.' WHEN 'P' THEN 'Solved with ' || p_name ELSE NULL END"),
        "registered": f"CASE event_type WHEN 'signup' THEN 'not a date' WHEN 'view' THEN replace({ts}, ' ', ' - ') ELSE {ts} END",
        "priority": _case("o_orderpriority", PRIORITIES),
        "superior_unit": "CASE WHEN source = 'src0' THEN NULL ELSE lang END",
        "fault_type": "nullif(event_type, 'signup')",
        "routing_time": "value",
        "routing_waiting_time": "CAST(p_size AS DOUBLE)",
        "total_routing_time": "CAST(CASE event_type WHEN 'view' THEN -1.0 WHEN 'signup' THEN NULL ELSE value * 2 END AS DOUBLE)",
        "total_time": "o_totalprice",
        "routed": "toxic = 1",
        "is_duplicate_report": "quality = 0",
        "duplicate_reports": f"CASE quality WHEN 0 THEN 'HA' || {text('doc_id')} || ', HB' || {text('o_custkey')} WHEN 1 THEN 'none' ELSE NULL END",
        "product_rstate": f"CASE WHEN p_type = 'LARGE' THEN NULL ELSE 'KDU137848 R' || {text('p_size')} || 'A' END",
        "product_no": product,
        "node_product_no": f"CASE o_orderstatus WHEN 'F' THEN {product} WHEN 'O' THEN 'KRC161842' ELSE NULL END",
        "primary_report": f"'H' || {text('o_custkey')}",
        "analysis_fault_type": "o_orderstatus",
        "improvement_type": "p_brand",
        "register_date": "CAST(o_orderdate AS DATE)",
    }


SPARK_COLUMNS = _expressions("date_format(ts, 'yyyy-MM-dd HH:mm:ss')")
SQL_COLUMNS = _expressions("strftime(ts, '%Y-%m-%d %H:%M:%S')")

# Source columns behind the expressions, to tell which tables a column list needs.
_SOURCE_COLUMNS = {
    "labels": ["quality", "toxic"], "events": ["event_type", "ts", "value"],
    "orders": ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey", "o_orderdate"],
    "part": ["p_name", "p_brand", "p_type", "p_size"],
}


def _needed(columns: list[str]) -> list[str]:
    words = set(re.findall(r"[a-z_]+", " ".join(SQL_COLUMNS[c] for c in columns)))
    return [name for name, cols in _SOURCE_COLUMNS.items() if words & set(cols)]


def reports(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given report columns (all by default) of every document."""
    wanted = list(columns or SPARK_COLUMNS)
    df = table(spark, sf_dir, "documents")
    if set(wanted) & {"observation", "answer"}:
        df = spread(df)
    for name in _needed(wanted):
        key = SOURCES[name]
        other = table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), *_SOURCE_COLUMNS[name])
        df = df.join(other, "doc_id", "left")
    return df.select(*[F.expr(SPARK_COLUMNS[c]).alias(c) for c in wanted])


def reports_sql(*columns: str) -> str:
    wanted = list(columns or SQL_COLUMNS)
    joins = " ".join(f"LEFT JOIN {n} ON {SOURCES[n] if n != 'labels' else 'labels.doc_id'} = documents.doc_id" for n in _needed(wanted))
    exprs = ", ".join(f"{'documents.doc_id' if c == 'ingest_pos' else re.sub(r'\bdoc_id\b', 'documents.doc_id', SQL_COLUMNS[c])} AS {c}" for c in wanted)
    return f"SELECT {exprs} FROM documents {joins}"
