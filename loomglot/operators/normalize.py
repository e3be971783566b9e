"""Normalising keys and placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import styled
from ..functions.placeholders import normalize_placeholders
from ..schema import CatalogError


def normalize(entries: DataFrame, key_style: str = "none", placeholders: bool = True, sort: bool = True) -> DataFrame:
    """Entries with restyled keys, portable placeholders and (``sort``) ``entry_ord`` by key in byte order, and the column ``changed``.

    Raises nothing itself: see ``collisions``.
    """
    out = entries.withColumn("__id", styled(F.col("id"), key_style)).withColumn("__text", F.col("text")).withColumn("__forms", F.col("forms"))
    if placeholders:
        out = out.withColumn("__text", normalize_placeholders(F.col("text"))).withColumn("__forms", F.transform_values("forms", lambda _, v: normalize_placeholders(v)))
    order = F.col("entry_ord")
    if sort:
        order = (F.row_number().over(Window.partitionBy("resource_ord").orderBy("__id", "entry_ord")) - 1).cast("bigint")
    was = F.row_number().over(Window.partitionBy("resource_ord").orderBy("entry_ord")) - 1
    same_forms = F.to_json(F.array_sort(F.map_entries("forms"))).eqNullSafe(F.to_json(F.array_sort(F.map_entries("__forms"))))
    out = out.withColumn("__order", order).withColumn("__was", was)
    moved = F.col("__order") != F.col("__was") if sort else F.lit(False)
    out = out.withColumn("changed", (F.col("id") != F.col("__id")) | ~F.col("text").eqNullSafe(F.col("__text")) | ~same_forms | moved)
    new = {"id": "__id", "text": "__text", "forms": "__forms", "entry_ord": "__order"}
    return out.select(*(F.col(new.get(c, c)).alias(c) for c in entries.columns), "changed")


def collisions(entries: DataFrame, key_style: str) -> DataFrame:
    """``resource_ord, id, entries``: keys that several entries of a resource would share."""
    return entries.groupBy("resource_ord", styled(F.col("id"), key_style).alias("id")).agg(F.count("*").alias("entries")).filter("entries > 1")


def normalize_strict(entries: DataFrame, key_style: str = "none", **options) -> DataFrame:
    """``normalize``, or an error and no result where keys collide."""
    if key_style != "none" and (hit := collisions(entries, key_style).orderBy("resource_ord", "id").first()):
        raise CatalogError("key_collision", f"{hit['entries']} entries share the key {hit['id']}", id=hit["id"])
    return normalize(entries, key_style, **options)
