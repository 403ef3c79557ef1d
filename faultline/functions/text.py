"""Text expressions. All are native columns, so they stay inside one codegen stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inline flags that make Java regexes read like Python ones: `.` stops only at \n (d) and
# \s \w \d \b are Unicode-aware (U).
PY = "dU"

# Layout of the report texts.
SECTION_PATTERNS = {
    "effect": r"1\s+E\s*F\s*F\s*E\s*C\s*T.*?\n={3,}(.*?)(?=\n\s*2\s+T\s*R\s*O\s*U\s*B\s*L\s*E|$)",
    "trouble": r"2\s+T\s*R\s*O\s*U\s*B\s*L\s*E.*?\n={3,}(.*?)(?=\n\s*3\s+M\s*E\s*A\s*S\s*U\s*R\s*E|$)",
    "config": r"2\.2\s+Configuration\s+Data.*?\n-{3,}(.*?)(?=\n\s*2\.3|\n\s*3\s+M\s*E\s*A\s*S|$)",
    "measures": r"3\s+M\s*E\s*A\s*S\s*U\s*R\s*E.*?\n={3,}(.*?)(?=\n\s*4|$)",
    "csr": r"4\s+CSR.*?\n={3,}(.*?)(?=$)",
}
EFFECT_OR_FULL_PATTERN = r"1\s+E\s*F\s*F\s*E\s*C\s*T\s*.*?\n={5,}(.*?)(?=2\s+T\s*R\s*O\s*U\s*B\s*L\s*E)"
CAUSE_PATTERN = r"CAUSE OF FAULT\s*\n-{10,}(.*?)(?=\n-{10,})"
SEPARATOR = " [SEP] "

_SPACE = r"[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    return f"(?{PY}{'i' if ignore_case else ''}{'s' if dot_all else ''}){pattern}"


def blank_if_null(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def clean_text(c) -> Column:
    """Lower-case ASCII letters, any other run of characters becomes one space."""
    return F.trim(F.lower(F.regexp_replace(blank_if_null(c), "[^a-zA-Z]+", " ")))


def clean_alphanum(c) -> Column:
    """As clean_text, but digits and dots stay."""
    return F.trim(F.lower(F.regexp_replace(blank_if_null(c), "[^a-zA-Z0-9.]+", " ")))


def section(c, name: str) -> Column:
    return strip(F.regexp_extract(blank_if_null(c), regex(SECTION_PATTERNS[name], True, True), 1))


def sections(c) -> Column:
    """All five observation sections as one struct; '' where a section is absent."""
    return F.struct(*[section(c, name).alias(name) for name in SECTION_PATTERNS])


def _extract_or_full(c, pattern: str) -> Column:
    text, p = blank_if_null(c), regex(pattern, True, True)
    return F.when(text.rlike(p), strip(F.regexp_extract(text, p, 1))).otherwise(text)


def effect_or_full(c) -> Column:
    """Effect section up to the trouble header; the full text if the layout is absent."""
    return _extract_or_full(c, EFFECT_OR_FULL_PATTERN)


def cause_of_fault(c) -> Column:
    return _extract_or_full(c, CAUSE_PATTERN)


def combined_text(heading, observation, answer=None) -> Column:
    parts = [blank_if_null(heading), F.lit(SEPARATOR), effect_or_full(observation)]
    if answer is not None:
        parts += [F.lit(SEPARATOR), cause_of_fault(answer)]
    return clean_text(F.concat(*parts))


def word_count(c) -> Column:
    """Number of whitespace-separated words; 0 for null and blank text."""
    text = strip(blank_if_null(c))
    return F.when(text == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(rf"(?U){_SPACE}+")) + 1).cast("int")


def joined_words(*cols) -> Column:
    """Cumulative text for forward selection: the parts joined by one space."""
    return F.concat_ws(" ", *[blank_if_null(c) for c in cols])


def tokens(c) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def with_ngrams(words: str, ngram_max: int) -> Column:
    """The tokens of a token column followed by their n-grams. Takes a column name, not an expression,
    so that the tokens are not computed again for every n-gram."""
    parts, grams = [F.col(words)], F.col(words)
    for n in range(2, ngram_max + 1):
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), count), F.slice(words, F.lit(n), count), lambda a, b: F.concat_ws(" ", a, b))
        parts.append(grams)
    return F.concat(*parts) if len(parts) > 1 else parts[0]
