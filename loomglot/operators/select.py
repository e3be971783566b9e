"""Filters, searches and listings over entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..schema import INPUT_ORDER, STATUSES, CatalogError


def by_language(entries: DataFrame, language: str, loose: bool = False) -> DataFrame:
    """Entries of a language: the same text, or (loose) any tag that matches it."""
    return entries.filter(L.matches(F.col("language"), F.lit(language)) if loose else F.col("language") == language)


def include_exclude(entries: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Entries of the listed languages and not of the excluded ones; lists are separated by commas."""
    for names, wanted in ((include, True), (exclude, False)):
        listed = [x.strip() for x in (names or "").split(",") if x.strip()]
        if listed:
            entries = entries.filter(F.col("language").isin(listed) if wanted else ~F.col("language").isin(listed))
    return entries


def parse_statuses(text: str) -> list[str]:
    """Statuses separated by commas, in any case, hyphens or spaces for underscores, each once."""
    names = list(dict.fromkeys(x.strip().lower().replace("-", "_").replace(" ", "_") for x in text.split(",") if x.strip()))
    if not names or (unknown := [x for x in names if x not in STATUSES]):
        raise CatalogError("invalid_status", f"no such status: {unknown}" if names else "the list of statuses is empty")
    return names


def by_status(entries: DataFrame, statuses: str) -> DataFrame:
    return entries.filter(F.col("status").isin(parse_statuses(statuses)))


def find(entries: DataFrame, key: str) -> DataFrame:
    """The first entry of a key in each resource."""
    first = Window.partitionBy("resource_ord").orderBy("entry_ord")
    return entries.filter(F.col("id") == key).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def shown_text() -> Column:
    """The text that stands for an entry: a plural shows its ``other`` form."""
    return F.when(F.col("kind") == "plural", F.try_element_at("forms", F.lit("other"))).when(F.col("kind") == "singular", F.col("text"))


def translated(entries: DataFrame) -> DataFrame:
    """``id, language`` of keys that have a text."""
    return entries.filter(F.coalesce(shown_text(), F.lit("")) != "").select("id", "language").distinct()


def missing_translations(entries: DataFrame) -> DataFrame:
    """``id, language`` of every key without a text in a language of the catalog. The languages of a catalog are few, its keys many, so
    each key is taken with the array of languages rather than joined with all."""
    every = entries.agg(F.array_sort(F.collect_set("language")).alias("every"))  # bounded by the languages there are
    keys = entries.groupBy("id").agg(F.collect_set(F.when(F.coalesce(shown_text(), F.lit("")) != "", F.col("language"))).alias("have"))
    return keys.crossJoin(F.broadcast(every)).select("id", F.explode(F.array_except("every", "have")).alias("language"))  # one row wide


def search(entries: DataFrame, needle: str, missing_only: bool = False) -> DataFrame:
    """Entries of keys whose name or text in any language holds ``needle``, in any case; maybe only keys that miss a language."""
    low = F.lower(F.lit(needle))
    hit = F.contains(F.lower("id"), low) | F.contains(F.lower(F.coalesce(shown_text(), F.lit(""))), low)
    keys = entries.groupBy("id").agg(F.bool_or(hit).alias("hit")).filter("hit").select("id")
    if missing_only:
        keys = keys.join(missing_translations(entries).select("id").distinct(), "id", "left_semi")
    return entries.join(keys, "id", "left_semi")


def languages(entries: DataFrame) -> DataFrame:
    """``language, entries, keys`` of each language."""
    return entries.groupBy("language").agg(F.count("*").alias("entries"), F.countDistinct("id").alias("keys"))


def all_keys(entries: DataFrame) -> DataFrame:
    return entries.select("id").distinct()


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("language", "status").agg(F.count("*").alias("matches"))


def view_summary(entries: DataFrame) -> DataFrame:
    """One row: ``total_matches``, the sorted ``languages`` and, as a map, how many entries each of the ``statuses`` has."""
    counts = status_counts(entries)
    statuses = counts.groupBy("status").agg(F.sum("matches").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))  # five at most
    total = counts.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("total_matches"), F.array_sort(F.collect_set("language")).alias("languages"))
    return total.crossJoin(F.broadcast(statuses))  # one row


def non_empty_resources(resources: DataFrame, entries: DataFrame) -> DataFrame:
    """Resources that have entries."""
    return resources.join(entries.select("resource_ord").distinct(), "resource_ord", "left_semi")


def union_all(*catalogs: DataFrame) -> DataFrame:
    """Entries of several catalogs, one after the other: later resources get numbers above those before."""
    offset, parts = F.lit(0), []
    base = None
    for part in catalogs:
        if base is not None:
            part = part.crossJoin(F.broadcast(base)).withColumn("resource_ord", F.col("resource_ord") + F.col("__base")).drop("__base")  # one row
        parts.append(part)
        base = part.agg((F.coalesce(F.max("resource_ord"), F.lit(-1)) + 1 + offset).alias("__base"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def latest(entries: DataFrame, *keys: str | Column, newest: bool = True) -> DataFrame:
    """One entry for each combination of ``keys``: the last in input order, or the first."""
    order = [F.col(c).desc() if newest else F.col(c) for c in INPUT_ORDER]
    return entries.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def single_language(resources: DataFrame, language: str | None = None) -> str:
    """The one language to write where a format holds one; none or several to choose from is an error."""
    rows = resources if language is None else resources.filter(L.matches(F.col("language"), F.lit(language)))
    names = [r["language"] for r in rows.select("language").distinct().limit(2).collect()]
    if len(names) != 1:
        raise CatalogError("single_language", "no language matches" if not names else "several languages match; name one")
    return names[0]


def fill_metadata(resources: DataFrame, source_language: str, version: str = "1.0") -> DataFrame:
    """Resources that lack a source language or version get them."""
    own = F.coalesce("custom", F.create_map().cast("map<string,string>"))
    default = F.create_map(F.lit("source_language"), F.lit(source_language), F.lit("version"), F.lit(version))
    lacking = F.map_filter(default, lambda k, _: ~F.map_contains_key(own, k))
    return resources.withColumn("custom", F.map_concat(own, lacking))
