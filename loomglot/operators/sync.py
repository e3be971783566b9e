"""Carrying values over to the keys that a target already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import languages as L
from ..schema import CatalogError, value_key
from .select import latest

VALUE = ["kind", "text", "plural_id", "forms"]
OUTCOMES = ("updated", "unchanged", "type_mismatch", "missing_language", "unmatched", "ambiguous")


def match_language(resources: DataFrame, explicit: str | None = None) -> str:
    """The language whose texts stand for keys: the given one, the source language that the first resource names, English if there is some,
    the first resource's language, English."""
    if explicit and explicit.strip():
        return explicit
    rows = resources.select("resource_ord", "language", F.try_element_at("custom", F.lit("source_language")).alias("named"))
    got = rows.agg(F.min_by("language", "resource_ord").alias("first"), F.min_by(F.coalesce("named", F.lit("")), "resource_ord").alias("named"), F.bool_or(L.normalized(F.col("language")) == "en").alias("english")).first()
    return got["named"] or ("en" if got["english"] or not got["first"] else got["first"])


def _aliases(source: DataFrame, resources: DataFrame | None, language: str) -> DataFrame:
    """``alias, candidate``: distinct keys by their singular text in the first matching resource."""
    listed = (source if resources is None else resources).filter(L.matches(F.col("language"), F.lit(language))).agg(F.min("resource_ord").alias("__first"))
    texts = source.join(F.broadcast(listed), F.col("resource_ord") == F.col("__first")).filter("kind = 'singular' and text <> ''")  # one row
    return texts.select(F.col("text").alias("alias"), F.col("id").alias("candidate")).distinct()


def resolve(source: DataFrame, target: DataFrame, language: str = "en", source_resources: DataFrame | None = None, target_resources: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """For each target entry: the source key it takes its value from, how it was found, the value and the outcome.

    A key that the source has in any language is exact. Else the key is looked up as a source text in the match language, then the target's own text
    of the key in that language; one candidate is taken, of several the only one that has a value in the entry's language; otherwise the entry is
    ambiguous. A value is that of the entry's language, or of the only source language with the same base.
    """
    source_values = latest(source.withColumn("lang", L.normalized(F.col("language"))), "id", "lang")
    source_values = source_values.select(F.col("id").alias("key"), "lang", F.split_part("lang", F.lit("-"), F.lit(1)).alias("base"), F.struct(*VALUE).alias("value"), value_key().alias("vkey"))
    by_base = source_values.groupBy("key", "base").agg(F.count("*").alias("n_base"), F.first("value").alias("base_value"), F.first("vkey").alias("base_vkey"))
    rows = target if only is None else target.filter(L.matches(F.col("language"), F.lit(only)))
    rows = rows.withColumn("lang", L.normalized(F.col("language"))).withColumn("base", F.split_part("lang", F.lit("-"), F.lit(1)))
    known = source_values.select(F.col("key").alias("__known")).distinct()
    tokens = _aliases_of_target(target, target_resources, language)
    rows = rows.join(known, F.col("id") == F.col("__known"), "left").join(tokens, F.col("id") == F.col("__token_id"), "left")

    # Candidates are counted before they meet the target's rows: by alias, by alias and base (keys with one value of that base) and by alias and
    # language (keys with several values of its base, which the other count leaves out). So every join adds at most one row to a row.
    aliases = _aliases(source, source_resources, language)
    shared = aliases.groupBy("alias").agg(F.count("*").alias("n"), F.min("candidate").alias("any_id"))
    held = aliases.join(by_base.select(F.col("key").alias("candidate"), "base", "n_base"), "candidate")
    loose = held.filter("n_base = 1").groupBy("alias", "base").agg(F.count("*").alias("n_loose"), F.min("candidate").alias("loose_id"))
    strict = held.filter("n_base > 1").join(source_values.select(F.col("key").alias("candidate"), "base", "lang"), ["candidate", "base"])
    strict = strict.groupBy("alias", "lang").agg(F.count("*").alias("n_strict"), F.min("candidate").alias("strict_id"))

    open_key = F.when(F.col("__known").isNull(), F.col("id"))
    open_token = F.when(F.col("__known").isNull(), F.col("token"))
    names = shared.select(F.col("alias").alias("__by_key"))
    rows = rows.withColumn("__key", open_key).join(names, F.col("__key") == F.col("__by_key"), "left").withColumn("alias", F.coalesce("__by_key", open_token)).drop("__key", "__by_key")
    rows = rows.join(shared, "alias", "left").join(loose, ["alias", "base"], "left").join(strict, ["alias", "lang"], "left")
    rows = rows.withColumn("n_ok", F.coalesce("n_loose", F.lit(0)) + F.coalesce("n_strict", F.lit(0))).withColumn("ok_id", F.least("loose_id", "strict_id"))
    by_base = by_base.filter("n_base = 1").drop("n_base")
    several = F.col("n") > 1
    rows = rows.withColumn("how", F.when(F.col("__known").isNotNull(), "exact").when(F.col("n").isNull(), "none").when(several & (F.col("n_ok") != 1), "ambiguous").otherwise("fallback"))
    rows = rows.withColumn("key", F.when(F.col("how") == "exact", F.col("id")).when(F.col("how") == "fallback", F.when(several, F.col("ok_id")).otherwise(F.col("any_id"))))
    rows = rows.join(source_values.select("key", "lang", "value", "vkey"), ["key", "lang"], "left").join(by_base, ["key", "base"], "left")
    rows = rows.withColumn("new", F.coalesce("value", "base_value")).withColumn("new_key", F.coalesce("vkey", "base_vkey"))
    return rows.withColumn("outcome", _outcome()).select(*target.columns, "how", F.col("key").alias("source_id"), "new", "outcome")


def _aliases_of_target(target: DataFrame, resources: DataFrame | None, language: str) -> DataFrame:
    """``__token_id, token``: the target's own singular text of each key in the first resource of the match language; the last holds."""
    listed = (target if resources is None else resources).filter(L.matches(F.col("language"), F.lit(language))).agg(F.min("resource_ord").alias("__first"))
    texts = target.join(F.broadcast(listed), F.col("resource_ord") == F.col("__first")).filter("kind = 'singular' and text <> ''")  # one row
    return latest(texts, "id").select(F.col("id").alias("__token_id"), F.col("text").alias("token"))


def _outcome() -> Column:
    return (
        F.when(F.col("how") == "ambiguous", "ambiguous")
        .when(F.col("how") == "none", "unmatched")
        .when(F.col("new").isNull(), "missing_language")
        .when(F.col("new.kind") != F.col("kind"), "type_mismatch")
        .when(F.col("new_key") == value_key(), "unchanged")
        .otherwise("updated")
    )


def sync(source: DataFrame, target: DataFrame, provenance: str | None = None, **options) -> DataFrame:
    """The target with updated values (status and comment stay; no key is added), as entries and the columns ``how, source_id, outcome``.

    ``provenance`` names the origin in the ``custom`` map of updated entries.
    """
    rows = resolve(source, target, **options)
    update = F.col("outcome") == "updated"
    for c in VALUE:
        rows = rows.withColumn(c, F.when(update, F.col(f"new.{c}")).otherwise(F.col(c)))
    if provenance is not None:
        kept = F.map_filter(F.coalesce("custom", F.create_map().cast("map<string,string>")), lambda k, _: k != "provenance.origin")
        rows = rows.withColumn("custom", F.when(update, F.map_concat(kept, F.create_map(F.lit("provenance.origin"), F.lit(provenance)))).otherwise(F.col("custom")))
    return rows.drop("new")


def report(resolved: DataFrame) -> DataFrame:
    """One row of counts; fallbacks count where they updated."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return resolved.agg(F.count("*").alias("processed"), *counts, F.count_if((F.col("outcome") == "updated") & (F.col("how") == "exact")).alias("exact_matches"), F.count_if((F.col("outcome") == "updated") & (F.col("how") == "fallback")).alias("fallback_matches"))


def fail_on(resolved: DataFrame, ambiguous: bool = True, unmatched: bool = True) -> None:
    """Raise if there are ambiguous entries, then if there are unmatched ones."""
    got = report(resolved).first()
    for wanted, name in ((ambiguous, "ambiguous"), (unmatched, "unmatched")):
        if wanted and got[name]:
            raise CatalogError(f"{name}_entries", f"{got[name]} entries are {name}", count=got[name])
