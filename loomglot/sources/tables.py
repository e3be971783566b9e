"""Wide tables of languages (CSV and TSV) and their long form."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CatalogError


def to_long(wide: DataFrame, languages: list[str]) -> DataFrame:
    """``id, language, text, status`` of a table ``key, <language>...``; every cell counts as translated, an empty one too."""
    return wide.select(F.col("key").alias("id"), *languages).unpivot("id", languages, "language", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("status", F.lit("translated"))


def to_wide(entries: DataFrame, languages: list[str]) -> DataFrame:
    """``key, <language>...``: the text of each key and language, empty where there is none or no singular. Of a key repeated in a resource the
    first counts, of several resources the last. The languages are given, so no job looks for them."""
    first = Window.partitionBy("resource_ord", "language", "id").orderBy("entry_ord")
    rows = entries.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    rows = rows.withColumn("__text", F.when(F.col("kind") == "singular", F.col("text")).otherwise(F.lit("")))
    wide = rows.groupBy(F.col("id").alias("key")).pivot("language", languages).agg(F.max_by("__text", "resource_ord"))
    return wide.fillna("", subset=languages)


def parse_table(content: str, separator: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """``language, [(key, text)]`` of a file. Two columns under ``key`` are one language; two without it one named ``default``, all rows data;
    more are a header of languages. A ragged row or a single column is an error."""
    rows = [r for r in csv.reader(io.StringIO(content), delimiter=separator, strict=True) if r]
    if not rows:
        return []
    width = len(rows[0])
    if width < 2:
        raise CatalogError("invalid_table", "a table needs a column of keys and one of texts")
    if bad := next((k for k, r in enumerate(rows) if len(r) != width), None):
        raise CatalogError("ragged_row", f"row {bad + 1} has {len(rows[bad])} columns, not {width}", row=bad + 1)
    if width == 2 and rows[0][0].strip().lower() != "key":
        return [("default", [(k, v) for k, v in rows])]
    return [(language, [(r[0], r[c]) for r in rows[1:]]) for c, language in enumerate(rows[0][1:], 1)]


def render_table(keys: list[str], languages: list[str], texts: dict[tuple[str, str], str], separator: str) -> str:
    out = io.StringIO()
    writer = csv.writer(out, delimiter=separator, lineterminator="\n")
    writer.writerow(["key", *languages])
    for key in keys:
        writer.writerow([key, *(texts.get((key, language), "") for language in languages)])
    return out.getvalue()
