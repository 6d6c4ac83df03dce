"""Question parsing, labels and formats as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations.
MONTH_ALIASES = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}
# Terms that put a question in scope.
SCOPE_TERMS = (
    "forecast", "demand", "month", "scenario", "assumption", "market share", "pfizer", "surgifoam", "rebate", "historical",
    "history", "spike", "drop", "increase", "decrease", "driver", "model", "actual",
)
# Market-share assumption in words, by lowest share, then the label at or
# below LOW_SHARE and the one for everything between.
SCENARIO_LABELS = (
    (1.0, "severe competitor-stockout scenario"),
    (0.8, "high share-capture transition scenario"),
    (0.65, "elevated share-capture scenario"),
)
LOW_SHARE, LOW_SHARE_LABEL = 0.45, "constrained complementary-product scenario"
NORMAL_LABEL = "normalized market-share assumption"
MISSING_LABEL = "not available"
# Family names for display.
FAMILY_LABELS = {"prophet": "Prophet", "sarimax": "SARIMAX", "catboost": "CatBoost"}


def in_scope(question: Column, terms: Sequence[str] = SCOPE_TERMS) -> Column:
    """Whether the text mentions one of the terms, in any case."""
    return F.lower(question).rlike("|".join(terms))


def tokens(question: Column) -> Column:
    """Runs of letters, digits and underscores, of any script."""
    return F.split(question, r"[^\p{L}\p{N}_]+")


def years(question: Column) -> Column:
    """Distinct years 2020-2099 named as whole words, ascending."""
    found = F.filter(tokens(question), lambda t: t.rlike(r"^20[2-9][0-9]$"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def month(question: Column) -> Column:
    """The first month name or abbreviation, as a number."""
    aliases = F.create_map(*[x for k, v in MONTH_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    known = F.filter(tokens(F.lower(question)), lambda t: F.map_contains_key(aliases, t))
    return F.try_element_at(aliases, F.try_element_at(known, F.lit(1)))


def scenario_label(share: Column) -> Column:
    """Market-share assumption in words."""
    out = F.when(share.isNull(), MISSING_LABEL)
    for lowest, label in SCENARIO_LABELS:
        out = out.when(share >= lowest, label)
    return out.when(share <= LOW_SHARE, LOW_SHARE_LABEL).otherwise(NORMAL_LABEL)


def activity(*columns: Column) -> Column:
    """State of the first available flag."""
    value = F.coalesce(*columns)
    return F.when(value.isNull(), MISSING_LABEL).when(value > 0, "active").otherwise("not active")


def family_label(family: Column) -> Column:
    """Display name of a model family."""
    out = F.when(family.isNull() | (family == ""), "production champion")
    for k, v in FAMILY_LABELS.items():
        out = out.when(F.lower(family) == k, v)
    return out.otherwise(family)


def format_share(share: Column) -> Column:
    """Share as a whole percentage; values up to 1.5 count as fractions."""
    percent = F.when(share <= 1.5, share * 100).otherwise(share)
    return F.when(share.isNull(), MISSING_LABEL).otherwise(F.concat(F.bround(percent, 0).cast("bigint").cast("string"), F.lit("%")))


def format_number(value: Column, decimals: int = 2, suffix: str = "", missing: str = "N/A") -> Column:
    """Fixed decimals with a suffix."""
    return F.when(value.isNull() | F.isnan(value), missing).otherwise(
        F.concat(F.format_string(f"%.{decimals}f", F.bround(value, decimals)), F.lit(suffix))
    )


def format_percentage(ratio: Column, decimals: int = 1, missing: str = "N/A") -> Column:
    """A ratio as a percentage."""
    return format_number(ratio * 100, decimals, "%", missing)


def format_optional(value: Column, default: str = "Not available") -> Column:
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), default).otherwise(text)


def format_date(value: Column, default: str = "N/A") -> Column:
    """The date part of a date, timestamp or text."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), default).otherwise(F.substring(text, 1, 10))


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def coefficient_position(name: Column) -> Column:
    """Position of a driver coefficient called x1, x2, ...; null for structural terms."""
    return F.nullif(F.regexp_extract(name, r"^x(\d+)$", 1), F.lit("")).cast("int")
