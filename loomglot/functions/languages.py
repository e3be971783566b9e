"""Language codes: normalising, matching, validating, and reading them off paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language, then optional script, region and variants.
TAG = r"^(?:[A-Za-z]{2,3}|[A-Za-z]{5,8})(?:[-_][A-Za-z]{4})?(?:[-_](?:[A-Za-z]{2}|[0-9]{3}))?(?:[-_](?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*$"


def normalized(language: Column) -> Column:
    return F.lower(F.replace(F.trim(language), F.lit("_"), F.lit("-")))


def base(language: Column) -> Column:
    return F.split_part(normalized(language), F.lit("-"), F.lit(1))


def matches(a: Column, b: Column) -> Column:
    """Equal after normalising, or of the same base language (so regions of one language match each other)."""
    return (normalized(a) == normalized(b)) | (base(a) == base(b))


def is_valid(language: Column) -> Column:
    return F.coalesce(language.rlike(TAG), F.lit(False))


def valid_tag(language: str) -> bool:
    return re.match(TAG, language) is not None


def language_of_path(path: str) -> str | None:
    """The language a path names, from the file name upwards: ``fr.lproj``, ``values-zh-rCN``, ``values-b+zh+Hans``, a stem of two
    lower-case letters or one with a hyphen; ``values`` alone is English."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    for k, part in enumerate(reversed(parts)):
        stem = part.rsplit(".", 1)[0] if k == 0 or part.endswith(".lproj") else part
        found = None
        if part.endswith(".lproj"):
            found = stem
        elif part == "values":
            return "en"
        elif part.startswith("values-b+"):
            found = part[len("values-b+") :].replace("+", "-")
        elif part.startswith("values-"):
            found = re.sub(r"-r([A-Z]{2})$", r"-\1", part[len("values-") :])
        elif re.fullmatch("[a-z]{2}", stem) or "-" in stem:
            found = stem
        if found is not None:
            found = found.replace("_", "-")
            if valid_tag(found):
                return found
    return None


def language_from_path(path: Column) -> Column:
    """``language_of_path`` as an expression, for columns of paths."""
    parts = F.reverse(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != ""))

    def one(part, place):
        stem = F.regexp_replace(part, r"\.[^.]*$", "")
        found = (
            F.when(part.endswith(".lproj"), stem)
            .when(part == "values", F.lit("en"))
            .when(part.startswith("values-b+"), F.replace(F.substring(part, 10, 1 << 20), F.lit("+"), F.lit("-")))
            .when(part.startswith("values-"), F.regexp_replace(F.substring(part, 8, 1 << 20), "-r([A-Z]{2})$", "-$1"))
            .when((place == 0) & (stem.rlike("^[a-z]{2}$") | stem.contains("-")), stem)
            .when((place > 0) & (part.rlike("^[a-z]{2}$") | part.contains("-")), part)
        )
        found = F.replace(found, F.lit("_"), F.lit("-"))
        return F.when(is_valid(found), found)

    return F.try_element_at(F.filter(F.transform(parts, one), lambda x: x.isNotNull()), F.lit(1))
