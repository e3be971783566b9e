"""Apple string catalogs (``.xcstrings``)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from ..schema import CatalogError
from .model import Entry, Resource, category, in_order, portable_to_apple


_SPACE = re.compile(r"[ \t\n\r]*").match


def _value(localization: dict) -> tuple[str, str | None, dict | None, str] | None:
    """Kind, text, forms and status; the unit comes before variations, and neither is no row at all."""
    unit = localization.get("stringUnit")
    if unit is not None:
        return ("singular" if unit.get("value") else "empty", unit.get("value") or "", None, unit.get("state") or "stale")
    forms = {category(c): v["stringUnit"] for c, v in ((localization.get("variations") or {}).get("plural") or {}).items() if v.get("stringUnit")}
    if not forms:
        return None
    first = in_order(forms)[0][1]
    return ("plural", None, {c: u.get("value") or "" for c, u in forms.items()}, first.get("state") or "stale")


def _flags(item: dict) -> tuple[dict, bool]:
    """What goes into ``custom``, and whether the key is to be translated."""
    custom = {k: str(item[k2]) for k, k2 in (("extraction_state", "extractionState"),) if item.get(k2)}
    if item.get("isCommentAutoGenerated"):
        custom["is_comment_auto_generated"] = "true"
    return custom, item.get("shouldTranslate") is not False


def localized(key: str, item: dict, source: str) -> list[tuple[str, Entry]] | None:
    """Languages and entries of a key; none at all where it has no localization."""
    if not item.get("localizations"):
        return None
    custom, translate = _flags(item)
    found = {name: v for name, x in item["localizations"].items() if (v := _value(x))}
    out = [
        (name, Entry(key, kind, text, forms, "" if forms else None, item.get("comment"), state if translate else "do_not_translate", dict(custom)))
        for name, (kind, text, forms, state) in found.items()
    ]
    if source not in found and translate:
        out.append((source, Entry(key, "singular" if key.strip() else "empty", key, comment=item.get("comment"), status="new", custom=custom)))
    return out


def bare_entry(key: str, item: dict) -> Entry:
    custom, translate = _flags(item)
    return Entry(key, "empty", "", comment=item.get("comment"), status="new" if translate else "do_not_translate", custom=custom)


def bare_languages(item: dict, known: list[str], source: str) -> list[str]:
    """Where a key without localizations goes, after all others."""
    return (known or [source]) if _flags(item)[1] else [source]


def parse(content: bytes, language: str | None = None) -> list[Resource]:
    """One resource a language.

    A key without its source language gets it, with the key as text, unless it is not to be translated. A key without any localization is new and empty in every
    language, or not to be translated in the source language.
    """
    try:
        data = json.loads(content)
    except ValueError as e:
        raise CatalogError("invalid_json", str(e)) from e
    source, version = data.get("sourceLanguage") or "en", data.get("version") or "1.0"
    out: dict[str, Resource] = {}

    def home(name):
        return out.setdefault(name, Resource(name, custom={"source_language": source, "version": version}))

    bare = []
    for key, item in (data.get("strings") or {}).items():
        found = localized(key, item, source)
        if found is None:
            bare.append((key, item))
        for name, entry in found or ():
            home(name).entries.append(entry)
    for key, item in bare:
        for name in bare_languages(item, list(out), source):
            home(name).entries.append(bare_entry(key, item))
    return [out[k] for k in sorted(out)]


def _unit(e: Entry, text: str) -> dict:
    return {"stringUnit": {"state": e.status, "value": portable_to_apple(text).replace("\\n", "\n")}}


def heading(resources: list[Resource]) -> tuple[str, str]:
    """Source language and version, the same for all."""
    heads = {(r.custom.get("source_language"), r.custom.get("version")) for r in resources}
    if len(heads) != 1 or None in next(iter(heads)):
        raise CatalogError("inconsistent_metadata", "all languages must name the same source language and version")
    return next(iter(heads))


def add_entry(item: dict, language: str, e: Entry) -> None:
    """An entry into the item of its key; the first gives its comment and flags."""
    if not item:
        item["localizations"] = {}
        if e.comment:
            item["comment"] = e.comment
        if e.custom.get("extraction_state"):
            item["extractionState"] = e.custom["extraction_state"]
        if e.custom.get("is_comment_auto_generated") == "true":
            item["isCommentAutoGenerated"] = True
        if e.status == "do_not_translate":
            item["shouldTranslate"] = False
    if e.kind == "singular":
        item["localizations"][language] = _unit(e, e.text or "")
    elif e.kind == "plural":
        item["localizations"][language] = {"variations": {"plural": {c: _unit(e, v) for c, v in in_order(e.forms or {})}}}


def render(resources: list[Resource]) -> str:
    """All languages in one file, keys sorted; the first entry of a key gives its comment and flags."""
    source, version = heading(resources)
    strings: dict[str, dict] = {}
    for r in resources:
        for e in r.entries:
            add_entry(strings.setdefault(e.id, {}), r.language, e)
    for item in strings.values():
        if not item["localizations"]:
            del item["localizations"]
    return json.dumps({"sourceLanguage": source, "strings": strings, "version": version}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def rendered_item(key: str, item: dict) -> str:
    """A key as it stands in a file, from its line's start."""
    item = {k: v for k, v in item.items() if k != "localizations" or v}
    return json.dumps({"": {key: item}}, ensure_ascii=False, indent=2, sort_keys=True).removeprefix('{\n  "": {\n').removesuffix("\n  }\n}")


def file_ends(source: str, version: str, some: bool) -> tuple[str, str]:
    """What stands before and after the keys of a file."""
    text = lambda x: json.dumps(x, ensure_ascii=False)
    return f'{{\n  "sourceLanguage": {text(source)},\n  "strings": {{', ("\n  " if some else "") + f'}},\n  "version": {text(version)}\n}}\n'


class Unordered(Exception):
    """A file that has to be parsed whole."""


def members(chunks: Iterator[str]) -> Iterator[tuple[str, str | None, object]]:
    """The members of a file given in pieces: ``name, None, value``, and ``strings, key, item`` for each key, of which one is held at a time."""
    decode, text, at, over = json.JSONDecoder().raw_decode, "", 0, False

    def more():
        nonlocal text, at, over
        chunk = next(chunks, None)
        over = chunk is None
        text, at = text[at:] + (chunk or ""), 0

    def mark():
        nonlocal at
        while True:
            at = _SPACE(text, at).end()
            if at < len(text):
                return text[at]
            if over:
                return ""
            more()

    def value():
        nonlocal at
        mark()
        while True:
            try:
                found, end = decode(text, at)
                if end < len(text) or over:
                    at = end
                    return found
            except ValueError as e:
                if over:
                    raise CatalogError("invalid_json", str(e)) from e
            more()

    def take(wanted):
        nonlocal at
        found = mark()
        if not found or found not in wanted:
            raise CatalogError("invalid_json", f"one of {wanted} is missing")
        at += 1
        return found

    def pairs():
        take("{")
        if mark() == "}":
            take("}")
            return
        while True:
            if mark() != '"':
                raise CatalogError("invalid_json", "a name is missing")
            name = value()
            take(":")
            yield name
            if take(",}") == "}":
                return

    for name in pairs():
        if name == "strings":
            if mark() != "{":
                raise Unordered
            for key in pairs():
                yield name, key, value()
        else:
            yield name, None, value()
    if mark():
        raise CatalogError("invalid_json", "there is text after the end")


def survey(chunks: Iterator[str]) -> tuple[str, str, list[str]]:
    """Source language, version and languages of a file. One whose keys do not ascend, or whose source language comes late, or that repeats a member, has to be parsed whole."""
    head, names, bare, last = {}, set(), [False, False], None
    for name, key, item in members(chunks):
        if name != "strings":
            if name in head or name == "sourceLanguage" and last is not None:
                raise Unordered
            head[name] = item
            continue
        if last is not None and key <= last:
            raise Unordered
        last = key
        found = localized(key, item, head.get("sourceLanguage") or "en")
        if found is None:
            bare[_flags(item)[1]] = True
        names.update(x for x, _ in found or ())
    source = head.get("sourceLanguage") or "en"
    if bare[False] or bare[True] and not names:
        names.add(source)
    return source, head.get("version") or "1.0", sorted(names)


def entries_in_order(read: Callable[[], Iterator[str]], source: str) -> Iterator[tuple[str, Entry]]:
    """Languages and entries of a file that ``survey`` took, those of each language in their order; the file is read twice."""
    known: dict[str, None] = {}
    for name, key, item in members(read()):
        for language, entry in (localized(key, item, source) or ()) if name == "strings" else ():
            known[language] = None
            yield language, entry
    for name, key, item in members(read()):
        if name == "strings" and not item.get("localizations"):
            for language in bare_languages(item, list(known), source):
                known[language] = None
                yield language, bare_entry(key, item)
