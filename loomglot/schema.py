"""The canonical model of localization catalogs as two DataFrames.

``resources`` holds one row per (file, language); ``entries`` one row per translatable key of a resource. ``resource_ord`` and
``entry_ord`` carry the input order, which first-wins and last-wins rules need; readers and derivations emit them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())

RESOURCES = T.StructType(
    [
        T.StructField("resource_ord", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("custom", TEXT_MAP),
        T.StructField("source_path", T.StringType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("resource_ord", T.LongType()),
        T.StructField("entry_ord", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("plural_id", T.StringType()),
        T.StructField("forms", TEXT_MAP),
        T.StructField("comment", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("custom", TEXT_MAP),
    ]
)
#: Fixed values.
KINDS = ("empty", "singular", "plural")
STATUSES = ("do_not_translate", "new", "stale", "needs_review", "translated")
CATEGORIES = ("zero", "one", "two", "few", "many", "other")
STRATEGIES = ("first", "last", "skip")
INPUT_ORDER = ("resource_ord", "entry_ord")


class CatalogError(ValueError):
    """An error with a machine-readable ``code`` and a ``context``."""

    def __init__(self, code: str, message: str, **context):
        super().__init__(message)
        self.code, self.context = code, context


def as_entries(df: DataFrame) -> DataFrame:
    """``df`` with all entry columns; absent ones get their default and others are dropped."""
    defaults = {
        "resource_ord": F.lit(0),
        "entry_ord": F.lit(0),
        "domain": F.lit(""),
        "kind": F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit("empty")).otherwise(F.lit("singular")) if "text" in df.columns else F.lit("empty"),
        "status": F.lit("new"),
        "custom": F.create_map().cast(TEXT_MAP),
    }
    return df.select(*((F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in ENTRIES))


def value_key(prefix: str = "") -> Column:
    """A value as comparable text: maps have no equality, so forms go in as sorted entries."""
    c = lambda name: F.col(prefix + name)
    return F.to_json(F.struct(c("kind").alias("k"), c("text").alias("t"), c("plural_id").alias("p"), F.array_sort(F.map_entries(c("forms"))).alias("f")), {"ignoreNullFields": "false"})


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)
