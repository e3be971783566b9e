"""Differences between two catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages as L
from ..schema import value_key
from .select import latest


def _values(entries: DataFrame, side: str) -> DataFrame:
    rows = latest(entries.withColumn("__lang", L.normalized(F.col("language"))), "__lang", "id")
    return rows.select(F.col("__lang").alias("language"), "id", value_key().alias(side), F.lit(True).alias(f"in_{side}"))


def diff(source: DataFrame, target: DataFrame, language: str | None = None) -> DataFrame:
    """``language, id, change`` for every key of either side.

    ``added``: in the source alone; ``removed``: in the target alone; ``changed``: the values differ; else ``unchanged``. Only values
    count, not status or comment. Of a key repeated in a language the last holds. ``language`` keeps matching languages.
    """
    if language is not None:
        source, target = (x.filter(L.matches(F.col("language"), F.lit(language))) for x in (source, target))
    both = _values(source, "source").join(_values(target, "target"), ["language", "id"], "full_outer")
    change = F.when(F.col("in_target").isNull(), "added").when(F.col("in_source").isNull(), "removed").when(F.col("source") != F.col("target"), "changed").otherwise("unchanged")
    return both.select("language", "id", change.alias("change"))


def summary(differences: DataFrame) -> DataFrame:
    """Counts by language."""
    count = lambda name: F.count_if(F.col("change") == name).alias(name)
    return differences.groupBy("language").agg(*(count(c) for c in ("added", "removed", "changed", "unchanged")))
