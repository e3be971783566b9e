"""XLIFF 1.2."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from ..schema import CatalogError
from .model import Entry, Resource, xml_escaped

NAMESPACE = "urn:oasis:names:tc:xliff:document:1.2"


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _plain(element) -> str:
    if len(element):
        raise CatalogError("unsupported_format", f"inline markup in {_name(element)} is not read")
    return element.text or ""


def domain_of(original: str) -> str:
    return re.sub(r"\.[^.]*$", "", original.replace("\\", "/").rsplit("/", 1)[-1])


def parse(content: bytes, language: str | None = None) -> list[Resource]:
    """A source and a target resource for each file element; a missing or empty target is new."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        raise CatalogError("invalid_xml", str(e)) from e
    if _name(root) != "xliff" or root.get("version") != "1.2":
        raise CatalogError("unsupported_format", "only version 1.2 is read")
    out: list[Resource] = []
    for file in (x for x in root if _name(x) == "file"):
        original, datatype = file.get("original") or "", file.get("datatype") or ""
        if any(w in x.lower() for x in (original, datatype) for w in ("stringsdict", "plural")):
            raise CatalogError("unsupported_format", f"{original} holds plurals, which are not read")
        source_language, target_language = file.get("source-language"), file.get("target-language")
        if not source_language:
            raise CatalogError("missing_language", f"{original} has no source language")
        custom = {"source_language": source_language, "xliff.original": original, "xliff.datatype": datatype}
        source = Resource(source_language, domain_of(original), dict(custom))
        target = Resource(target_language, domain_of(original), dict(custom)) if target_language else None
        seen = set()
        for body in (x for x in file if _name(x) == "body"):
            for unit in body:
                if _name(unit) in ("group", "bin-unit"):
                    raise CatalogError("unsupported_format", f"{_name(unit)} is not read")
                if _name(unit) != "trans-unit":
                    continue
                key = unit.get("id")
                if not key:
                    raise CatalogError("missing_id", f"a unit of {original} has no id")
                if key in seen:
                    raise CatalogError("duplicate_id", f"{original} has {key} twice", id=key)
                seen.add(key)
                parts: dict[str, list[str]] = {"source": [], "target": [], "note": []}
                for x in unit:
                    if _name(x) in parts:
                        parts[_name(x)].append(_plain(x))
                if parts["target"] and target is None:
                    raise CatalogError("missing_language", f"{key} has a target, {original} no target language")
                comment = "\n\n".join(n.strip() for n in parts["note"] if n.strip()) or None
                extra = {"xliff.resname": unit.get("resname")} if unit.get("resname") else {}
                text = "".join(parts["source"])
                source.entries.append(Entry(key, "singular" if text else "empty", text, comment=comment, status="translated" if text else "new", custom=dict(extra)))
                if target is not None:
                    text = "".join(parts["target"])
                    target.entries.append(Entry(key, "singular" if text else "empty", text, comment=comment, status="translated" if text else "new", custom=dict(extra)))
        out += [source] + ([target] if target else [])
    return out


def languages_of(resources: list[Resource], source: str | None = None, target: str | None = None) -> tuple[str, str]:
    """Source and target language: as given, as the metadata agree on, or the only ones left."""
    names = sorted({r.language for r in resources})
    if source is None:
        named = {r.custom["source_language"] for r in resources if r.custom.get("source_language")}
        rest = [n for n in names if n != target]
        source = named.pop() if len(named) == 1 else rest[0] if len(rest) == 1 else None
    if target is None:
        rest = [n for n in names if n != source]
        target = rest[0] if len(rest) == 1 else None
    if source is None or target is None or source not in names or target not in names:
        raise CatalogError("ambiguous_language", f"source and target cannot be told from {names}")
    return source, target


def render(resources: list[Resource], source: str | None = None, target: str | None = None) -> str:
    """One source and one target language; a file element for each original, units by id. A target without its source is an error."""
    source, target = languages_of(resources, source, target)
    files: dict[str, dict[str, dict[str, Entry]]] = {}
    kinds: dict[str, str] = {}
    for r in resources:
        if r.language in (source, target):
            original = r.custom.get("xliff.original") or r.domain or "Localizable"
            kinds.setdefault(original, r.custom.get("xliff.datatype") or "plaintext")
            side = files.setdefault(original, {"s": {}, "t": {}})["s" if r.language == source else "t"]
            for e in r.entries:
                if e.kind == "plural":
                    raise CatalogError("data_mismatch", f"{e.id} is plural, which this format cannot hold", id=e.id)
                side[e.id] = e
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', f'<xliff version="1.2" xmlns="{NAMESPACE}">']
    for original in sorted(files):
        sides = files[original]
        if lost := sorted(set(sides["t"]) - set(sides["s"])):
            raise CatalogError("missing_source", f"{lost[0]} has a target but no source", id=lost[0])
        q = lambda x: xml_escaped(x, True)
        lines += [f'  <file original="{q(original)}" source-language="{q(source)}" target-language="{q(target)}" datatype="{q(kinds[original])}">', "    <body>"]
        for key in sorted(sides["s"]):
            e, t = sides["s"][key], sides["t"].get(key)
            name = f' resname="{q(e.custom["xliff.resname"])}"' if e.custom.get("xliff.resname") else ""
            lines += [f'      <trans-unit id="{q(key)}"{name}>', f"        <source>{xml_escaped(e.text or '')}</source>"]
            if t is not None and t.kind == "singular":
                lines.append(f"        <target>{xml_escaped(t.text or '')}</target>")
            comment = e.comment or (t.comment if t else None) or ""
            lines += [f"        <note>{xml_escaped(n.strip())}</note>" for n in re.split(r"\n\s*\n", comment) if n.strip()]
            lines.append("      </trans-unit>")
        lines += ["    </body>", "  </file>"]
    return "\n".join([*lines, "</xliff>", ""])
