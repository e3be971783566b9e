"""Changes of single entries; each returns a new DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STATUSES, CatalogError
from .select import latest


def _is(language: str, key: str):
    return (F.col("language") == language) & (F.col("id") == key)


def _require(entries: DataFrame, language: str, key: str) -> None:
    if entries.filter(_is(language, key)).isEmpty():
        raise CatalogError("entry_not_found", f"no entry {key} in {language}", id=key, language=language)


def _check_status(status: str | None) -> None:
    if status is not None and status not in STATUSES:
        raise CatalogError("invalid_status", f"no such status: {status}")


def add(entries: DataFrame, language: str, key: str, text: str, comment: str | None = None, status: str = "new") -> DataFrame:
    """One more entry at the end of the language's first resource, or of a new resource. A key may repeat."""
    _check_status(status)
    at = entries.agg(
        F.min(F.when(F.col("language") == language, F.col("resource_ord"))).alias("home"),
        (F.coalesce(F.max("resource_ord"), F.lit(-1)) + 1).alias("next"),
        (F.coalesce(F.max("entry_ord"), F.lit(-1)) + 1).alias("last"),
    )
    values = {"resource_ord": F.coalesce("home", "next"), "entry_ord": F.col("last"), "language": F.lit(language), "domain": F.lit(""), "id": F.lit(key), "kind": F.lit("singular" if text else "empty"), "text": F.lit(text), "comment": F.lit(comment), "status": F.lit(status)}
    return entries.unionByName(at.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema)))


def update(entries: DataFrame, language: str, key: str, text: str, status: str | None = None) -> DataFrame:
    """A new text for a key; its status stays unless one is given."""
    _check_status(status)
    _require(entries, language, key)
    out = entries.withColumn("__hit", _is(language, key)).withColumn("text", F.when(F.col("__hit"), F.lit(text)).otherwise(F.col("text")))
    out = out.withColumn("kind", F.when(F.col("__hit"), F.lit("singular")).otherwise(F.col("kind")))
    if status is not None:
        out = out.withColumn("status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status")))
    return out.drop("__hit")


def remove(entries: DataFrame, language: str | None, key: str) -> DataFrame:
    """Without a key (all its copies) in one language, or with ``None`` in all."""
    if language is None:
        return entries.filter(F.col("id") != key)
    _require(entries, language, key)
    return entries.filter(~_is(language, key))


def copy(entries: DataFrame, key: str, source: str, target: str, status: str | None = None) -> DataFrame:
    """The source language's first entry of a key in place of the target language's, at the end."""
    _check_status(status)
    _require(entries, source, key)
    rest = entries.filter(~_is(target, key))
    home = entries.agg(F.min(F.when(F.col("language") == target, F.col("resource_ord"))).alias("__home"), (F.max("resource_ord") + 1).alias("__next"), (F.max("entry_ord") + 1).alias("__last"))
    one = latest(entries.filter(_is(source, key)), "id", newest=False).crossJoin(F.broadcast(home))  # one row
    one = one.withColumn("language", F.lit(target)).withColumn("resource_ord", F.coalesce("__home", "__next")).withColumn("entry_ord", F.col("__last"))
    if status is not None:
        one = one.withColumn("status", F.lit(status))
    return rest.unionByName(one.select(entries.columns))


def set_value(entries: DataFrame, language: str, key: str, text: str | None, status: str | None = None) -> DataFrame:
    """Set a text, adding the key if need be; an empty or absent text removes the key."""
    if not text:
        return remove(entries, language, key)
    if entries.filter(_is(language, key)).isEmpty():
        return add(entries, language, key, text, status=status or "new")
    return update(entries, language, key, text, status)
