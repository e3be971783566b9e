"""JSON and YAML formats: maps of languages, arrays of such maps, and arrays of whole resources."""

from __future__ import annotations

import json

from ..schema import CatalogError
from .model import Entry, Resource, category, in_order


def _loaded(content: bytes):
    try:
        return json.loads(content)
    except ValueError as e:
        raise CatalogError("invalid_json", str(e)) from e


def _add(out: dict[str, Resource], item: dict, custom: dict[str, str]) -> None:
    """The key is the field ``key``, else the English text, else the first text. A key repeated in a language takes the new value at its old place."""
    if not isinstance(item, dict) or any(not isinstance(v, str) for v in item.values()):
        raise CatalogError("invalid_value", "a map of languages must hold texts alone")
    if not item:
        return
    key = item.get("key", item.get("en", next(iter(item.values()))))
    for language, text in item.items():
        if language != "key":
            entry = Entry(key, "singular" if text else "empty", text, status="needs_review", custom={"extraction_state": "manual"} | custom)
            entries = out.setdefault(language, Resource(language)).entries
            place = next((k for k, e in enumerate(entries) if e.id == key), None)
            if place is None:
                entries.append(entry)
            else:
                entries[place] = entry


def parse_map(content: bytes, language: str | None = None) -> list[Resource]:
    out: dict[str, Resource] = {}
    _add(out, _loaded(content), {})
    return list(out.values())


def parse_array(content: bytes, language: str | None = None) -> list[Resource]:
    data, out = _loaded(content), {}
    if not isinstance(data, list):
        raise CatalogError("invalid_value", "an array of maps was expected")
    for k, item in enumerate(data):
        _add(out, item, {"array_index": str(k)})
    return list(out.values())


def parse_yaml(content: bytes, language: str | None = None) -> list[Resource]:
    import yaml  # only this format needs it

    out: dict[str, Resource] = {}
    _add(out, yaml.safe_load(content) or {}, {})
    return list(out.values())


def parse_resources(content: bytes, language: str | None = None) -> list[Resource]:
    """The whole model: an array of ``{metadata, entries}``, values as ``"Empty"``, ``{"Singular": text}`` or ``{"Plural": {id, forms}}``."""
    data = _loaded(content)
    if not isinstance(data, list) or not data:
        raise CatalogError("no_resources", "an array of resources was expected")
    out = []
    for r in data:
        try:
            meta = r["metadata"]
            resource = Resource(meta["language"], meta.get("domain", ""), dict(meta["custom"]))
            for e in r["entries"]:
                value, entry = e["value"], Entry(e["id"], "empty", "", comment=e.get("comment"), status=str(e["status"]).lower(), custom=dict(e.get("custom") or {}))
                if isinstance(value, dict) and "Singular" in value:
                    entry.kind, entry.text = "singular", value["Singular"]
                elif isinstance(value, dict) and "Plural" in value:
                    entry.kind, entry.text, entry.plural_id = "plural", None, value["Plural"]["id"]
                    entry.forms = {category(c): v for c, v in value["Plural"]["forms"].items()}
                elif value != "Empty":
                    raise CatalogError("invalid_value", f"the value of {entry.id} is neither empty, singular nor plural")
                resource.entries.append(entry)
        except (KeyError, TypeError, AttributeError) as e:
            raise CatalogError("invalid_value", f"a resource lacks {e}") from e
        out.append(resource)
    return out


def render_resources(resources: list[Resource]) -> str:
    def value(e: Entry):
        if e.kind == "plural":
            return {"Plural": {"id": e.plural_id or "", "forms": dict(in_order(e.forms or {}))}}
        return {"Singular": e.text or ""} if e.kind == "singular" else "Empty"

    data = [
        {
            "metadata": {"language": r.language, "domain": r.domain, "custom": r.custom},
            "entries": [{"id": e.id, "value": value(e), "comment": e.comment, "status": e.status, "custom": e.custom} for e in r.entries],
        }
        for r in resources
    ]
    return json.dumps(data, ensure_ascii=False, indent=2) + "\n"
