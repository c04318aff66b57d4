"""Address clean-up as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.lexicon import ABBREVIATION_RULES, REMARK_PATTERN, SCRIPT_RANGES

_ALNUM = "a-zA-Z0-9ऀ-ൿ"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


@lru_cache(maxsize=1)
def _nfc():
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return nfc


def normalize_unicode(text) -> Column:
    """NFC and plain quotes, dashes and spaces. Only rows with non-ASCII text are sent to Python."""
    t = _c(text)
    composed = F.coalesce(_nfc()(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)
    return F.translate(composed, "\u2019\u2018\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- ")


def _rule_key(pattern: str) -> str:
    """Letters every match of a rule starts with: the literal test that guards its regex."""
    letters, optional = re.match(r"\\b([a-z]+)(\??)", pattern).groups()
    return letters[:-1] if optional else letters


def _letters_first(pattern: str) -> str:
    """The same rule, but its letters are looked for before the word boundary, which is slow to test at every place."""
    key = _rule_key(pattern)
    return f"(?U){key}(?<=\\b{key}){pattern.removeprefix(rf'\b{key}')}"


def _count(text: Column, letters: str) -> Column:
    """How many characters of a class a text has; nothing is listed."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]+", ""))


def expand_abbreviations(text) -> Column:
    """Ordered rewrites of lower-cased text. A rule's regex only runs on text that holds its letters."""
    rules = F.array(
        *[
            F.struct(F.lit(_rule_key(p)).alias("key"), F.lit(_letters_first(p)).alias("pattern"), F.lit(r).alias("to"))
            for p, r in ABBREVIATION_RULES
        ]
    )
    return F.aggregate(
        rules,
        _c(text),
        lambda acc, r: F.when(F.contains(acc, r["key"]), F.regexp_replace(acc, r["pattern"], r["to"])).otherwise(acc),
    )


def normalize_punctuation(text) -> Column:
    out = F.regexp_replace(_c(text), r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"[;|/\\]+", ",")
    out = F.regexp_replace(out, r"(?U)\s*,\s*", ", ")
    out = F.regexp_replace(out, r",+", ",")
    return F.regexp_replace(out, r"^[ ,.;]+|[ ,.;]+$", "")


def strip(text) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def normalize_whitespace(text) -> Column:
    return strip(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def detect_language(text) -> Column:
    """Language of the script with most characters; the listed order breaks ties; null without letters."""
    counts = [(lang, _count(_c(text), f"{a}-{b}")) for lang, a, b in SCRIPT_RANGES]
    counts.append(("en", _count(_c(text), "a-zA-Z")))
    most = F.greatest(*[n for _, n in counts])
    out = F.when(most == 0, F.lit(None).cast("string"))
    for lang, n in counts:
        out = out.when(n == most, lang)
    return out


def extract_pincode(text) -> Column:
    return F.nullif(F.regexp_extract(_c(text), r"(?U)\b(\d{6})\b", 1), F.lit(""))


def normalization_confidence(raw, normalized) -> Column:
    r, n = _c(raw), _c(normalized)
    kept_of = _count(r, _ALNUM)
    kept = _count(n, _ALNUM)
    bonus = F.when(F.length(n) > F.length(r) * 0.8, 0.1).otherwise(0.0)
    value = F.least(F.lit(1.0), F.least(F.lit(1.0), kept / F.greatest(kept_of, F.lit(1))) + bonus)
    return F.when(F.length(r) == 0, 0.0).when(kept_of == 0, 0.5).otherwise(value)


def normalize_addresses(df: DataFrame, text: str) -> DataFrame:
    """Adds raw_address, normalized_address, language and norm_confidence."""
    raw = df.withColumn("raw_address", strip(F.coalesce(F.col(text), F.lit(""))))
    clean = F.lower(normalize_unicode("raw_address"))
    out = raw.withColumn("_clean", clean)
    out = out.withColumn("normalized_address", normalize_whitespace(normalize_punctuation(expand_abbreviations("_clean"))))
    return out.drop("_clean").withColumns(
        {
            "language": detect_language("raw_address"),
            "norm_confidence": normalization_confidence("raw_address", "normalized_address"),
        }
    )


def remark_correction(remark) -> Column:
    """The phrase of an agent's remark that corrects the address, or null."""
    return F.nullif(F.trim(F.regexp_extract(_c(remark), f"(?i){REMARK_PATTERN}", 0)), F.lit(""))
