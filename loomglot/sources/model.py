"""What file parsers return and renderers take: plain Python, one object a resource."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field

from ..schema import CATEGORIES, CatalogError


@dataclass
class Entry:
    id: str
    kind: str = "singular"
    text: str | None = None
    forms: dict[str, str] | None = None
    plural_id: str | None = None
    comment: str | None = None
    status: str = "new"
    custom: dict[str, str] = field(default_factory=dict)


@dataclass
class Resource:
    language: str
    domain: str = ""
    custom: dict[str, str] = field(default_factory=dict)
    entries: list[Entry] = field(default_factory=list)


def decoded(content: bytes) -> str:
    """Text by its byte-order mark, UTF-8 without one."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise CatalogError("invalid_encoding", "the file is neither UTF-8 nor marked as UTF-16") from e


def category(name: str) -> str:
    low = name.strip().lower()
    if low not in CATEGORIES:
        raise CatalogError("invalid_quantity", f"no such plural category: {name}")
    return low


def in_order(forms: dict[str, str]) -> list[tuple[str, str]]:
    """Plural forms in the order of the categories, which is not that of the alphabet."""
    return sorted(forms.items(), key=lambda x: CATEGORIES.index(x[0]))


def portable_to_apple(text: str) -> str:
    return re.sub(r"%([0-9]+\$)?l*s", r"%\1@", text.replace("%%", "\x01")).replace("\x01", "%%")


def xml_escaped(text: str, quote: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if quote else out
