"""SQL snippets that say the same as the DataFrame expressions, for checking results in another engine.

The other engine's regexes (RE2) lack look-ahead and Unicode \\w, \\b; the snippets spell these out."""

from __future__ import annotations

from ..functions.signals import (
    ALARM_RULES, BOARD_PATTERN, DUPLICATE_ID_PATTERN, FLAG_PATTERNS, PRIORITY_ORDINALS, PRODUCT_RULES, RELEASE_PATTERN, RSTATE_PATTERN,
)
from ..functions.text import CAUSE_PATTERN, EFFECT_OR_FULL_PATTERN, SECTION_PATTERNS

WORD = r"[\p{L}\p{N}_]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    p = pattern.replace("(?=", "(?:").replace(r"\bAL\b", rf"(?:^|[^\p{{L}}\p{{N}}_])AL(?:$|[^\p{{L}}\p{{N}}_])").replace(r"RDS\w+", f"RDS{WORD}+")
    return quote(f"(?{flags}){p}" if flags else p)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_text(x: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({x}, ''), '[^a-zA-Z]+', ' ', 'g')))"


def clean_alphanum(x: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({x}, ''), '[^a-zA-Z0-9.]+', ' ', 'g')))"


def section(x: str, name: str) -> str:
    return strip(f"regexp_extract(coalesce({x}, ''), {re2(SECTION_PATTERNS[name], 'is')}, 1)")


def _or_full(x: str, pattern: str) -> str:
    p = re2(pattern, "is")
    return f"CASE WHEN regexp_matches(coalesce({x}, ''), {p}) THEN {strip(f'regexp_extract({x}, {p}, 1)')} ELSE coalesce({x}, '') END"


def effect_or_full(x: str) -> str:
    return _or_full(x, EFFECT_OR_FULL_PATTERN)


def cause_of_fault(x: str) -> str:
    return _or_full(x, CAUSE_PATTERN)


def combined_text(heading: str, observation: str, answer: str) -> str:
    return clean_text(f"(coalesce({heading}, '') || ' [SEP] ' || {effect_or_full(observation)} || ' [SEP] ' || {cause_of_fault(answer)})")


def word_count(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> ''))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z0-9_]{{2,}}')"


def flag(x: str, name: str) -> str:
    pattern, ignore_case = FLAG_PATTERNS[name]
    return f"CAST(regexp_matches(coalesce({x}, ''), {re2(pattern, 'i' if ignore_case else '')}) AS INTEGER)"


def first_match(x: str, pattern: str) -> str:
    return f"coalesce(nullif(regexp_extract(coalesce({x}, ''), {re2(pattern)}, 1), ''), 'unknown')"


def parsed_time(x: str) -> str:
    return f"TRY_CAST(replace({x}, ' - ', ' ') AS TIMESTAMP)"


def first_rule(tests: list[str], values: list[str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values)) + f" ELSE {otherwise} END"


def alarm(x: str, part: int) -> str:
    tests = [f"{x} IS NULL"] + [f"regexp_matches({x}, {re2(p, 'i')})" for p, *_ in ALARM_RULES]
    return first_rule(tests, [quote("none")] + [quote(r[part]) for r in ALARM_RULES], quote("unknown"))


def product(x: str, part: int) -> str:
    number = f"replace(replace(coalesce({x}, ''), ' ', ''), '/', '')"
    return first_rule([f"starts_with({number}, {quote(r[0])})" for r in PRODUCT_RULES], [quote(r[part]) for r in PRODUCT_RULES], quote("unknown"))


def priority(x: str) -> str:
    return first_rule([f"{x} = {quote(k)}" for k in PRIORITY_ORDINALS], [str(v) for v in PRIORITY_ORDINALS.values()], "0")


SIGNALS = {
    **{name: flag("observation", name) for name in FLAG_PATTERNS},
    "hour_of_day": f"CAST(coalesce(hour({parsed_time('registered')}), -1) AS INTEGER)",
    "day_of_week": f"CAST(coalesce(isodow({parsed_time('registered')}) - 1, -1) AS INTEGER)",
    "reg_quarter": f"CAST(coalesce(quarter({parsed_time('registered')}), -1) AS INTEGER)",
    "reg_year": f"CAST(coalesce(year({parsed_time('registered')}), -1) AS INTEGER)",
    "log_routing_time": "round(ln(1 + coalesce(routing_time, 0)), 6)",
    "waiting_ratio": ("CASE WHEN coalesce(total_routing_time, 0) + 1 = 0 THEN CASE WHEN coalesce(routing_waiting_time, 0) > 0 THEN CAST('inf' AS DOUBLE) "
                      "WHEN coalesce(routing_waiting_time, 0) < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END "
                      "ELSE round(coalesce(routing_waiting_time, 0) / (coalesce(total_routing_time, 0) + 1), 6) END"),
    "auto_routed": "CAST(coalesce(routed, false) AS INTEGER)",
    "is_duplicate": "CAST(coalesce(is_duplicate_report, false) AS INTEGER)",
    "num_duplicates": f"CAST(coalesce(len(regexp_extract_all(duplicate_reports, {quote(DUPLICATE_ID_PATTERN)})), 0) AS INTEGER)",
    "rstate_major": f"coalesce(TRY_CAST(nullif(regexp_extract(coalesce(product_rstate, ''), {quote(RSTATE_PATTERN)}, 1), '') AS DOUBLE), -1)",
    "cross_component": "CAST(coalesce(product_no, '') <> coalesce(node_product_no, '') AS INTEGER)",
    "board_type": first_match("observation", BOARD_PATTERN),
    "sw_release": first_match("observation", RELEASE_PATTERN),
    "prod_family": product("product_no", 1), "prod_gen": product("product_no", 2), "prod_tech": product("product_no", 3),
    "alarm_category": alarm("observation", 1), "alarm_severity": alarm("observation", 2),
}


def select(names) -> str:
    return ", ".join(f"{SIGNALS[n]} AS {n}" for n in names)
