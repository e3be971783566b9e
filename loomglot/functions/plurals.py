"""Plural categories that a language requires."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import base

#: Required categories by base language; any other language requires ``other`` alone.
REQUIRED = {
    ("one", "other"): "en de nl sv da nb nn no is fi et fa hi bn gu ta te kn ml mr it es pt mk el eu gl af sw ur fil tl tr id ms fr hy kab",
    ("other",): "ja zh ko th vi km lo my yue",
    ("one", "few", "many", "other"): "ru uk be sr hr bs sh pl",
    ("one", "few", "other"): "cs sk lt ro",
    ("one", "two", "few", "other"): "sl",
    ("zero", "one", "other"): "lv",
    ("one", "two", "few", "many", "other"): "ga",
    ("zero", "one", "two", "few", "many", "other"): "ar",
    ("one", "two", "many", "other"): "he iw",
}


def required(language: Column) -> Column:
    """The categories a language requires, as an array."""
    out = F.array(F.lit("other"))
    for categories, languages in REQUIRED.items():
        out = F.when(base(language).isin(*languages.split()), F.array(*map(F.lit, categories))).otherwise(out)
    return out


def missing(language: Column, forms: Column) -> Column:
    return F.array_except(required(language), F.map_keys(forms))
