"""A second look at spans of personal data, by type and language, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language
from .decide import VALID_EMAIL

# Whole-text patterns of phones by language, and the confidence of a hit and of a miss.
PHONES = {
    "en": [r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$", r"^\+44\s?[0-9]{10,11}$"],
    "de": [r"^\+49\s?[0-9\s]{10,14}$", r"^0[0-9]{2,4}[-\s]?[0-9]{4,8}$"],
    "tr": [r"^\+90\s?[0-9]{10}$", r"^0[0-9]{3}[-\s]?[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{2}$"],
}
HIT, MISS = 0.9, 0.6


def phone_valid(value: Column, lang: Column) -> Column:
    """Whether the trimmed text is a phone of that language; unknown ones are tried as English."""
    fits = lambda k: F.trim(value).rlike("|".join(PHONES[k]))
    return F.when(lang == "de", fits("de")).when(lang == "tr", fits("tr")).otherwise(fits("en"))


def validated(spans: DataFrame, text: str = "text", kind: str = "type", lang: str | None = None) -> DataFrame:
    """``spans`` with valid and confidence; types other than EMAIL and PHONE have no check here and stay valid with 1.0."""
    value, of = F.col(text), F.col(kind)
    tongue = F.coalesce(F.col(lang), language(value)) if lang else language(value)
    ok = F.when(of == "EMAIL", value.rlike(VALID_EMAIL)).when(of == "PHONE", phone_valid(value, tongue)).otherwise(True)
    ok = F.coalesce(ok, F.lit(False))
    return spans.withColumns({"valid": ok, "confidence": F.when(~of.isin("EMAIL", "PHONE"), 1.0).otherwise(F.when(ok, HIT).otherwise(MISS))})


def valid_spans(spans: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """Only the spans that are valid with at least that confidence."""
    return validated(spans, **how).where((F.col("valid")) & (F.col("confidence") >= least)).drop("valid", "confidence")
