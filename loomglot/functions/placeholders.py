"""Placeholders in translated texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escaped percent, or a percent, an optional position, up to two ``l`` and a conversion letter or ``@``.
TOKEN = r"%%|%(?:([0-9]+)\$)?(?:ll[A-Za-z@]|l[A-Za-km-z@]|[A-Za-km-z@])"


def tokens(text: Column) -> Column:
    """The placeholders of a text as they stand, from left to right."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: t != "%%")


def normalize_placeholders(text: Column) -> Column:
    """Apple spellings to portable ones: ``%@`` and ``%1$@`` to ``s``, ``%ld`` to ``%d``, ``%lu`` to ``%u``."""
    text = F.regexp_replace(text, r"%([0-9]+)\$@", r"%$1\$s")
    for old, new in (("%@", "%s"), ("%ld", "%d"), ("%lu", "%u")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def signature(text: Column) -> Column:
    """The placeholders as position and conversion letter, after normalisation: ``["1$s", "d"]``."""
    found = tokens(normalize_placeholders(text))
    return F.transform(found, lambda t: F.concat(F.regexp_extract(t, r"^%([0-9]+\$)?", 1), F.translate(F.lower(F.right(t, F.lit(1))), "@", "s")))


def to_apple(text: Column) -> Column:
    """``%s`` and ``%1$s`` (with any ``l``) to ``@``, leaving escaped percents alone."""
    guarded = F.replace(text, F.lit("%%"), F.lit("\u0001"))
    return F.replace(F.regexp_replace(guarded, r"%([0-9]+\$)?l*s", "%$1@"), F.lit("\u0001"), F.lit("%%"))
