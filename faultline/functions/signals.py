"""Signals read out of one report: keyword flags, dates, routing numbers, product and alarm lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, blank_if_null, regex

# Keyword patterns and whether case is ignored.
FLAG_PATTERNS = {
    "flag_crash": (r"crash|pmd|core.?dump|program.?restart", True),
    "flag_alarm": (r"\bAL\b|alarm", True),
    "flag_cell_disabled": (r"cell.*disabled|disabled.*cell|CELLDISABLED", True),
    "flag_restart": (r"restart|reboot|cold.?start|warm.?start", True),
    "flag_upgrade": (r"upgrade|UP\s+\d{2}|R\d{2}[A-Z]\d+", True),
    "flag_race_cond": (r"race.?condition|deadlock|mutex|synchroni", True),
    "flag_log_traces": (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}", False),
    "flag_coli_output": (r"coli>|OFFLINE_", False),
}
BOARD_PATTERN = r"(BB\d{4}|AIR\d{4}|IRU\d{4}|RRU\d{4}|RDS\w+)"
RELEASE_PATTERN = r"(\d{2}\.Q\d(?:\.\d)?)"
DUPLICATE_ID_PATTERN = r"H[A-Z]\d+"
RSTATE_PATTERN = r"R(\d+)"

# Product number prefix -> (family, generation, technology); first match wins.
PRODUCT_RULES = [
    ("KDU137848", "Baseband_6630", "G2", "NR"),
    ("KDU1370015", "Baseband_6648", "G2", "LTE_NR"),
    ("KDU137925", "Baseband_5216", "G2", "LTE"),
    ("KRC161842", "IRU1649", "G3", "NR"),
    ("KRC161549", "RRUS2217", "G2", "LTE"),
    ("KRD901206", "AIR6449", "G3", "NR"),
    ("KRC161756", "Radio4449", "G3", "NR"),
    ("KRC161707", "RRU88430", "G2", "LTE"),
]

# Alarm text pattern (case ignored) -> (category, severity); first match wins.
ALARM_RULES = [
    ("License Key File Fault", "LicenseManagement", "critical"),
    ("Autonomous Mode Activated", "LicenseManagement", "major"),
    ("Emergency Unlock", "LicenseManagement", "major"),
    ("Resource Activation Timeout", "RadioResource", "major"),
    ("SW Error", "Software", "minor"),
    ("Cell.*[Dd]isabled", "RadioResource", "major"),
    ("RI.*[Ll]ink.*[Dd]own", "Transport", "major"),
    ("CPRI.*[Ff]ault", "Transport", "major"),
    ("Synchronization.*[Ll]ost", "Synchronization", "critical"),
]

# Ordinal of the submitter priority.
PRIORITY_ORDINALS = {"A": 1, "B": 2, "C": 3}

NUMERIC_SIGNALS = [
    *FLAG_PATTERNS, "hour_of_day", "day_of_week", "reg_quarter", "reg_year", "log_routing_time",
    "waiting_ratio", "auto_routed", "is_duplicate", "num_duplicates", "rstate_major", "cross_component",
]
CATEGORICAL_SIGNALS = [
    "board_type", "sw_release", "prod_family", "prod_gen", "prod_tech", "alarm_category", "alarm_severity",
]
UNKNOWN = "unknown"

# Inputs of `signals`, with the type used where a table lacks the column.
SIGNAL_INPUTS = {
    "observation": "string", "registered": "string", "routing_time": "double",
    "routing_waiting_time": "double", "total_routing_time": "double", "routed": "boolean",
    "is_duplicate_report": "boolean", "duplicate_reports": "string", "product_rstate": "string",
    "product_no": "string", "node_product_no": "string",
}


def flag(text, name: str) -> Column:
    pattern, ignore_case = FLAG_PATTERNS[name]
    return blank_if_null(text).rlike(regex(pattern, ignore_case)).cast("int")


def flags(text) -> list[Column]:
    return [flag(text, name).alias(name) for name in FLAG_PATTERNS]


def first_match(text, pattern: str, default: str = UNKNOWN) -> Column:
    found = F.regexp_extract(blank_if_null(text), regex(pattern), 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


# Date forms accepted beside the ISO ones, tried in this order.
DATE_FORMS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


def parse_time(c, dash_form: bool = True) -> Column:
    """Wall-clock timestamp, null where the text is no date. The form 'date - time' is accepted
    unless dash_form is off."""
    text = _col(c).cast("string")
    if dash_form:
        text = F.replace(text, F.lit(" - "), F.lit(" "))
    tries = [F.try_to_timestamp(text, F.lit(form)).try_cast("timestamp_ntz") for form in DATE_FORMS]
    return F.coalesce(text.try_cast("timestamp_ntz"), *tries)


def number_or_zero(c) -> Column:
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def waiting_ratio(waiting, total) -> Column:
    """waiting / (total + 1) with IEEE results where the divisor is 0."""
    w, d = number_or_zero(waiting), number_or_zero(total) + 1
    at_zero = (F.when(w > 0, F.lit(float("inf"))).when(w < 0, F.lit(float("-inf")))
               .otherwise(F.lit(float("nan"))))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(w, d))


def log_time(c) -> Column:
    """log1p with IEEE results at and below -1, where Spark gives null."""
    x = number_or_zero(c)
    return (F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))))


def is_true(c) -> Column:
    """1 for the value true, and for its text as exports spell it; other texts that a cast would accept (`yes`, `y`) are 0."""
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.coalesce(text.isin("true", "1"), F.lit(False)).cast("int")


def duplicate_id_count(c) -> Column:
    return F.coalesce(F.regexp_count(_col(c), F.lit(DUPLICATE_ID_PATTERN)), F.lit(0))


def rstate_major(c) -> Column:
    digits = F.regexp_extract(blank_if_null(c), regex(RSTATE_PATTERN), 1)
    return F.coalesce(F.when(digits != "", digits).try_cast("double"), F.lit(-1.0))


def cross_component(product, node_product) -> Column:
    return (blank_if_null(product) != blank_if_null(node_product)).cast("int")


def _first_rule(tests: list[Column], results: list[Column], otherwise: Column) -> Column:
    chain = F
    for test, result in zip(tests, results):
        chain = chain.when(test, result)
    return chain.otherwise(otherwise)


def product_info(c) -> Column:
    """Family, generation and technology of a product number as a struct."""
    number = F.translate(blank_if_null(c), " /", "")
    info = lambda f, g, t: F.struct(F.lit(f).alias("prod_family"), F.lit(g).alias("prod_gen"), F.lit(t).alias("prod_tech"))
    return _first_rule([number.startswith(p) for p, *_ in PRODUCT_RULES],
                       [info(*rest) for _, *rest in PRODUCT_RULES], info(UNKNOWN, UNKNOWN, UNKNOWN))


def alarm_info(c) -> Column:
    """Category and severity of the first alarm rule that matches; 'none' for a missing text."""
    text = _col(c)
    info = lambda cat, sev: F.struct(F.lit(cat).alias("alarm_category"), F.lit(sev).alias("alarm_severity"))
    return _first_rule([text.isNull()] + [text.rlike(regex(p, True)) for p, *_ in ALARM_RULES],
                       [info("none", "none")] + [info(*rest) for _, *rest in ALARM_RULES], info(UNKNOWN, UNKNOWN))


def priority_ordinal(c) -> Column:
    return _first_rule([_col(c) == k for k in PRIORITY_ORDINALS],
                       [F.lit(v) for v in PRIORITY_ORDINALS.values()], F.lit(0))


def date_parts(c, dash_form: bool = True) -> list[Column]:
    ts = parse_time(c, dash_form)
    part = lambda value, name: F.coalesce(value, F.lit(-1)).alias(name)
    return [part(F.hour(ts), "hour_of_day"), part(F.weekday(ts), "day_of_week"),
            part(F.quarter(ts), "reg_quarter"), part(F.year(ts), "reg_year")]


def routing_numbers() -> list[Column]:
    return [log_time("routing_time").alias("log_routing_time"),
            waiting_ratio("routing_waiting_time", "total_routing_time").alias("waiting_ratio"),
            is_true("routed").alias("auto_routed"),
            is_true("is_duplicate_report").alias("is_duplicate")]


def signals(dash_form: bool = True) -> list[Column]:
    """All engineered columns, for one select over a table that holds SIGNAL_INPUTS."""
    product, alarm = product_info("product_no"), alarm_info("observation")
    return [
        *flags("observation"), *date_parts("registered", dash_form), *routing_numbers(),
        duplicate_id_count("duplicate_reports").alias("num_duplicates"),
        rstate_major("product_rstate").alias("rstate_major"),
        cross_component("product_no", "node_product_no").alias("cross_component"),
        first_match("observation", BOARD_PATTERN).alias("board_type"),
        first_match("observation", RELEASE_PATTERN).alias("sw_release"),
        *[product[n].alias(n) for n in ("prod_family", "prod_gen", "prod_tech")],
        *[alarm[n].alias(n) for n in ("alarm_category", "alarm_severity")],
    ]
