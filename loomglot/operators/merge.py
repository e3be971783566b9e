"""Merging the resources of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INPUT_ORDER, STRATEGIES, CatalogError


def merge(entries: DataFrame, strategy: str = "last") -> DataFrame:
    """One entry a key in every language that has several resources.

    ``first`` and ``last`` take an entry by input order; ``skip`` drops every key that occurs more than once. A language with a single
    resource stays as it is. Merged entries take the number of the language's first resource.
    """
    if strategy not in STRATEGIES:
        raise CatalogError("invalid_strategy", f"a merge strategy must be one of {STRATEGIES}")
    key = Window.partitionBy("language", "id")
    order = key.orderBy(*(F.col(c).desc() if strategy == "last" else F.col(c) for c in INPUT_ORDER))
    spans = entries.groupBy("language").agg(F.min("resource_ord").alias("__first"), F.max("resource_ord").alias("__last"))
    several = spans.filter(F.col("__first") != F.col("__last")).drop("__last")
    # Only the languages that change are sorted, and of a key only the row that stays is kept on the way.
    merged = entries.join(several, "language").withColumn("__n", F.count("*").over(key) if strategy == "skip" else F.row_number().over(order)).filter(F.col("__n") == 1)
    untouched = entries.join(several.select("language"), "language", "left_anti").select(entries.columns)
    return merged.withColumn("resource_ord", F.col("__first")).select(entries.columns).unionByName(untouched)


def merged_languages(entries: DataFrame) -> DataFrame:
    """``language, resources`` of the languages that ``merge`` changes."""
    return entries.groupBy("language").agg(F.countDistinct("resource_ord").alias("resources")).filter("resources > 1")
