"""Apple ``.strings`` files."""

from __future__ import annotations

import re

from ..schema import CatalogError
from .model import Entry, Resource, decoded, portable_to_apple

PIECE = re.compile(r'\s+|(?P<block>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<pair>"(?P<key>(?:[^"\\]|\\.)*)"\s*=\s*"(?P<value>(?:[^"\\]|\\.)*)"\s*;?)|(?P<other>[^\n]+)', re.S)
LANGUAGE = re.compile(r"^\s*//\s?:\s*Language:\s*(\S.*?)\s*$")
HEADER_LINES = 50


def header_language(text: str) -> str | None:
    return next((m[1] for line in text.split("\n")[:HEADER_LINES] if (m := LANGUAGE.match(line))), None)


def without_header(text: str) -> str:
    """A run of line comments at the top is the generated header if any of them begins with ``//:``."""
    lines = text.lstrip().split("\n")
    n = next((k for k, x in enumerate(lines) if not x.lstrip().startswith("//")), len(lines))
    return "\n".join(lines[n:]) if any(x.lstrip().startswith("//:") for x in lines[:n]) else text


def parse(content: bytes, language: str | None = None) -> list[Resource]:
    """Pairs in file order; the last comment before a pair belongs to it; lines that are no pair are passed over; what stands in quotes stays as
    written, but for real newlines (and tabs beside them), which become escapes."""
    text = decoded(content)
    out = Resource(language or header_language(text) or "")
    comment = None
    for m in PIECE.finditer(without_header(text)):
        if m["block"] or m["line"]:
            comment = (m["block"] or m["line"]).strip()
        elif m["pair"]:
            value = m["value"]
            if "\n" in value:
                value = value.replace("\t", "\\t").replace("\r\n", "\n").replace("\n", "\\n")
            out.entries.append(Entry(m["key"], "singular", value, comment=comment, status="translated" if value else "new"))
            comment = None
    return [out]


def escaped(text: str) -> str:
    """Backslashes that escape nothing are doubled, quotes and newlines escaped."""
    text = re.sub(r"""(\\+)(?=[^\\ntr"'])|(\\+)\Z""", lambda m: m.group() * 2, text)
    text = re.sub(r'(?<!\\)"', r"\"", text)
    return re.sub(r"(?<!\\)\n", r"\\n", text)


def formatted_comment(comment: str) -> str:
    body = comment.strip()
    if body.startswith("//") or body.startswith("/*") and body.endswith("*/"):
        return body
    return f"/* {body.replace('*/', '* /')} */"


def render(resources: list[Resource]) -> str:
    """One language; entries in order; plural entries have no place here."""
    if len(resources) != 1:
        raise CatalogError("single_language", f"one resource can be written, not {len(resources)}")
    lines = [f"//: Language: {resources[0].language}", ""]
    for e in resources[0].entries:
        if e.kind == "plural":
            raise CatalogError("data_mismatch", f"{e.id} is plural, which this format cannot hold", id=e.id)
        if e.comment and e.comment.strip():
            lines.append(formatted_comment(e.comment))
        lines += [f'"{escaped(e.id)}" = "{escaped(portable_to_apple(e.text or ""))}";', ""]
    return "\n".join(lines)
