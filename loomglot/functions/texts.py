"""Texts for people and for files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES, STATUSES


def plain_text(text: Column) -> Column:
    """Trimmed, without tags, lines left-trimmed and joined by a literal backslash-n."""
    text = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"<[^>]+>", "")
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+", "")), "\\n")


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` code points; what is cut shows as three dots."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def escaped_newlines(text: Column) -> Column:
    """Real newlines as a literal backslash-n; tabs too, but only next to newlines."""
    return F.when(F.contains(text, F.lit("\n")), F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))).otherwise(text)


def forms_text(forms: Column) -> Column:
    """Plural forms in the order of their categories: ``one=x | other=y``."""
    known = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.map_contains_key(forms, c))
    return F.array_join(F.transform(known, lambda c: F.concat(c, F.lit("="), F.element_at(forms, c))), " | ")


def parsed_status(status: Column) -> Column:
    """A status in any case, hyphens or spaces for underscores; null if there is none such."""
    name = F.lower(F.regexp_replace(F.trim(status), "[- ]", "_"))
    return F.when(name.isin(*STATUSES), name)


def clean_comment(comment: Column) -> Column:
    """A comment without its markers."""
    body = F.regexp_replace(F.regexp_replace(comment, r"^\s*/\*+\s*|\s*\*+/\s*$", ""), r"^\s*//+\s?", "")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def notes_of(comment: Column) -> Column:
    """A comment as notes: parts between blank lines, trimmed, without empty ones."""
    parts = F.transform(F.split(comment, r"\n\s*\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def comment_of(notes: Column) -> Column:
    return F.array_join(F.filter(F.transform(notes, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n\n")


def xml_comment(text: Column) -> Column:
    """Two hyphens must not stand together in an XML comment."""
    return F.replace(F.replace(text, F.lit("--"), F.lit("- -")), F.lit("--"), F.lit("- -"))


def with_provenance(custom: Column, prefix: str, values: dict[str, str | None]) -> Column:
    """``custom`` with the provenance keys set, or removed where the value is null."""
    names = [prefix + k for k in values]
    kept = F.map_filter(custom, lambda k, _: ~k.isin(*names))
    new = [x for k, v in values.items() if v is not None for x in (F.lit(prefix + k), F.lit(v))]
    return F.map_concat(kept, F.create_map(*new)) if new else kept


def reply_field(reply: Column, field: str) -> Column:
    """A field of a JSON reply that may stand in a fenced block."""
    body = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.get_json_object(F.when(body != "", body).otherwise(reply), f"$.{field}")


def value_text(kind: Column, text: Column, forms: Column) -> Column:
    """A value on one line: a text as it is, plural forms in order, nothing for an empty one."""
    return F.when(kind == "plural", forms_text(forms)).when(kind == "singular", text).otherwise("")


def provenance(custom: Column, prefix: str) -> Column:
    """The provenance keys of a ``custom`` map, without their prefix."""
    held = F.map_filter(custom, lambda k, _: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(held, lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))
