"""Key styles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between a lower-case letter or digit and a capital, and before the last capital of a run that a lower-case letter follows.
BOUNDARY = r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
STYLES = ("none", "snake", "kebab", "camel")


def words(key: Column) -> Column:
    """Lower-case words joined by ``_``; empty where the key has none."""
    parted = F.regexp_replace(F.regexp_replace(key, BOUNDARY, "_"), r"[^\p{IsAlphabetic}\p{N}]+", "_")
    return F.lower(F.regexp_replace(parted, "^_+|_+$", ""))


def snake(key: Column) -> Column:
    return F.when(words(key) == "", key).otherwise(words(key))


def kebab(key: Column) -> Column:
    return F.when(words(key) == "", key).otherwise(F.replace(words(key), F.lit("_"), F.lit("-")))


def camel(key: Column) -> Column:
    parts = F.split(words(key), "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)))
    return F.when(words(key) == "", key).otherwise(F.concat(parts[0], F.array_join(rest, "")))


def styled(key: Column, style: str) -> Column:
    if style not in STYLES:
        raise ValueError(f"key style must be one of {STYLES}")
    return key if style == "none" else {"snake": snake, "kebab": kebab, "camel": camel}[style](key)
