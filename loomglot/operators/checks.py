"""Statistics and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import plurals
from ..functions.placeholders import signature
from ..schema import STATUSES, CatalogError


def completion(translated: Column, total: Column, untranslatable: Column) -> Column:
    """Percent of the translatable entries that are translated, to two places; 100 where there are none."""
    open_total = total - untranslatable
    return F.when(open_total == 0, F.lit(100.0)).otherwise(F.round(translated / open_total * 100, 2))


def stats(entries: DataFrame, by: tuple[str, ...] = ("resource_ord", "language")) -> DataFrame:
    """One row a resource: entries by status, completion, plural entries that miss categories and how many they miss."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    lacking = F.when(F.col("kind") == "plural", F.size(plurals.missing(F.col("language"), F.col("forms")))).otherwise(F.lit(0))
    out = entries.withColumn("__lacking", lacking).groupBy(*by).agg(F.count("*").alias("total"), *counts, F.count_if(F.col("__lacking") > 0).alias("missing_plural_entries"), F.sum("__lacking").alias("missing_plural_categories"))
    return out.withColumn("completion", completion(F.col("translated"), F.col("total"), F.col("do_not_translate")))


def stats_summary(entries: DataFrame, language: str | None = None) -> DataFrame:
    """Resources (of the language) and distinct keys (of all)."""
    wanted = F.lit(True) if language is None else F.col("language") == language
    return entries.agg(F.countDistinct(F.when(wanted, F.col("resource_ord"))).alias("resources"), F.countDistinct("id").alias("unique_keys"))


def entry_signature() -> Column:
    """The placeholders of an entry as one text: of a plural, those of all its forms by category, one after the other."""
    forms = F.transform(F.array_sort(F.map_entries("forms")), lambda e: F.array_join(signature(e["value"]), ","))
    return F.when(F.col("kind") == "plural", F.array_join(F.filter(forms, lambda s: s != ""), ",")).when(F.col("kind") == "singular", F.array_join(signature(F.col("text")), ",")).otherwise("")


def placeholder_issues(entries: DataFrame) -> DataFrame:
    """``id, signatures, languages`` of keys whose entries do not all have the same placeholders."""
    rows = entries.select("id", "language", entry_signature().alias("s"))
    return rows.groupBy("id").agg(F.countDistinct("s").alias("signatures"), F.countDistinct("language").alias("languages")).filter("signatures > 1")


def plural_form_issues(entries: DataFrame) -> DataFrame:
    """``id, language, signatures``: plural entries whose forms differ in placeholders among themselves. An addition: the key-wise check reads all
    forms as one text."""
    each = F.array_distinct(F.transform(F.map_values("forms"), lambda v: F.array_join(signature(v), ",")))
    return entries.filter("kind = 'plural'").select("id", "language", F.size(each).alias("signatures")).filter("signatures > 1")


def plural_issues(entries: DataFrame) -> DataFrame:
    """``language, id, missing, have`` of plural entries that lack a category their language requires."""
    plural = entries.filter("kind = 'plural'")
    return plural.select("resource_ord", "entry_ord", "language", "id", plurals.missing(F.col("language"), F.col("forms")).alias("missing"), F.map_keys("forms").alias("have")).filter(F.size("missing") > 0)


def autofix_plurals(entries: DataFrame) -> DataFrame:
    """Missing categories copied from ``other``, entries so changed marked as needing review, and the column ``added``. Entries that are not to
    be translated stay."""
    can = (F.col("kind") == "plural") & (F.col("status") != "do_not_translate") & F.map_contains_key("forms", F.lit("other"))
    lacking = F.when(can, plurals.missing(F.col("language"), F.col("forms"))).otherwise(F.array().cast("array<string>"))
    out = entries.withColumn("__lacking", lacking).withColumn("added", F.size("__lacking"))
    filled = F.map_concat("forms", F.map_from_arrays("__lacking", F.transform("__lacking", lambda _: F.element_at("forms", F.lit("other")))))
    out = out.withColumn("forms", F.when(F.col("added") > 0, filled).otherwise(F.col("forms")))
    return out.withColumn("status", F.when(F.col("added") > 0, F.lit("needs_review")).otherwise(F.col("status"))).drop("__lacking")


def structure_issues(resources: DataFrame, entries: DataFrame) -> DataFrame:
    """``issue, language``: languages of several resources, resources without entries, languages that are no tags."""
    twice = resources.groupBy("language").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_language").alias("issue"), "language")
    hollow = resources.join(entries.select("resource_ord").distinct(), "resource_ord", "left_anti").select(F.lit("empty_resource").alias("issue"), "language")
    odd = resources.filter(~L.is_valid(F.col("language"))).select(F.lit("invalid_language").alias("issue"), "language").distinct()
    return twice.unionByName(hollow).unionByName(odd)


def validate(resources: DataFrame, entries: DataFrame) -> None:
    """Raise on a catalog without resources, then on the first kind of structural issue."""
    if resources.isEmpty():
        raise CatalogError("no_resources", "the catalog has no resources")
    found = {r["issue"]: r["n"] for r in structure_issues(resources, entries).groupBy("issue").agg(F.count("*").alias("n")).collect()}  # three rows at most
    for issue in ("duplicate_language", "empty_resource"):
        if issue in found:
            raise CatalogError(issue, f"{found[issue]} times {issue}")
