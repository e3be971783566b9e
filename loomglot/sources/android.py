"""Android string resources."""

from __future__ import annotations

import re
from xml.parsers import expat

from ..schema import CatalogError
from .model import Entry, Resource, category, in_order, xml_escaped

SELF_CLOSED = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*/>""")


class _Reader:
    """Collects strings and plurals; the text of inline tags counts, CDATA does not."""

    def __init__(self, content: bytes):
        self.content, self.depth, self.note = content, 0, None
        self.item: dict | None = None  # the open string, or plural item
        self.plural: dict | None = None
        self.cdata = False
        self.strings, self.plurals = [], []
        self.parser = p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.CommentHandler = self.comment
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: setattr(self, "cdata", True), lambda: setattr(self, "cdata", False)

    def run(self):
        try:
            self.parser.Parse(self.content, True)
        except expat.ExpatError as e:
            raise CatalogError("invalid_xml", str(e)) from e
        return self

    def start(self, name, attributes):
        self.depth += 1
        if self.item is not None:
            return
        if self.depth == 2 and name in ("string", "plurals"):
            if SELF_CLOSED.match(self.content, self.parser.CurrentByteIndex):
                return
            if "name" not in attributes:
                raise CatalogError("missing_name", f"a {name} element has no name")
            held = {"name": attributes["name"], "translatable": attributes.get("translatable"), "comment": self.note, "depth": self.depth, "text": []}
            self.note = None
            if name == "string":
                self.item = held
            else:
                self.plural = held | {"forms": {}}
        elif self.plural is not None and name == "item":
            if "quantity" not in attributes:
                raise CatalogError("invalid_quantity", f"an item of {self.plural['name']} has no quantity")
            self.item = {"category": category(attributes["quantity"]), "depth": self.depth, "text": []}

    def text(self, data):
        if self.item is not None and not self.cdata:
            self.item["text"].append(data)

    def comment(self, data):
        if self.item is None and self.plural is None:
            self.note = data.strip()

    def end(self, name):
        if self.item is not None and self.item["depth"] == self.depth:
            text = "".join(self.item["text"])
            if "category" in self.item:
                self.plural["forms"][self.item["category"]] = text
            else:
                text = re.sub(r"\n[ \t]+\Z", "\n    ", text)
                self.strings.append(self.item | {"text": text.replace("\r\n", "\n").replace("\n", "\\n")})
            self.item = None
        elif self.plural is not None and self.plural["depth"] == self.depth:
            self.plurals.append(self.plural)
            self.plural = None
        self.depth -= 1


def _status(translatable: str | None, empty: bool) -> str:
    if translatable is not None:
        return "translated" if translatable == "true" else "do_not_translate"
    return "new" if empty else "translated"


def parse(content: bytes, language: str | None = None) -> list[Resource]:
    """Strings first, then plurals; arrays and self-closed elements are passed over; an XML comment belongs to the next element."""
    found = _Reader(content).run()
    out = Resource(language or "")
    for s in found.strings:
        out.entries.append(Entry(s["name"], "singular" if s["text"] else "empty", s["text"], comment=s["comment"], status=_status(s["translatable"], not s["text"])))
    for p in found.plurals:
        empty = not any(p["forms"].values())
        out.entries.append(Entry(p["name"], "plural" if p["forms"] else "empty", None, p["forms"] or None, p["name"], p["comment"], _status(p["translatable"], empty)))
    return [out]


def render(resources: list[Resource]) -> str:
    """One language: strings, then plurals with their items in the order of the categories. Empty entries are left out."""
    if len(resources) != 1:
        raise CatalogError("single_language", f"one resource can be written, not {len(resources)}")
    flag = {"translated": ' translatable="true"', "do_not_translate": ' translatable="false"'}
    lines = ['<?xml version="1.0" encoding="utf-8"?>', "<resources>"]
    for wanted in ("singular", "plural"):
        for e in (x for x in resources[0].entries if x.kind == wanted):
            if e.comment and e.comment.strip():
                note = e.comment.strip()
                while "--" in note:
                    note = note.replace("--", "- -")
                lines.append(f"    <!-- {note} -->")
            head = f'name="{xml_escaped(e.id, True)}"{flag.get(e.status, "")}'
            if wanted == "singular":
                lines.append(f"    <string {head}>{xml_escaped(e.text or '')}</string>")
            else:
                items = [f'        <item quantity="{c}">{xml_escaped(v)}</item>' for c, v in in_order(e.forms or {})]
                lines += [f"    <plurals {head}>", *items, "    </plurals>"]
    return "\n".join([*lines, "</resources>", ""])
