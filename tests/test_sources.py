import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomglot.schema import CatalogError
from loomglot.sources import android, apple_strings, files, json_maps, string_catalog, tables, xliff
from loomglot.sources.model import Entry, Resource

STRINGS = b"""//: Language: fr
// generated

/* note */
"a" = "x %@";
"b" = "line
\tnext";
garbage
// c
"d" = ""
"""
ANDROID = b"""<resources>
  <!-- note -->
  <string name="a">Hi <b>you</b><![CDATA[ lost]]> &amp; me</string>
  <string name="b" translatable="false">x
  y
   </string>
  <string name="gone"/>
  <string-array name="arr"><item>1</item></string-array>
  <plurals name="p"><item quantity="other">%d</item><item quantity="ONE">1</item><item quantity="one">one</item></plurals>
  <string name="e"></string>
</resources>"""
CATALOG = {
    "sourceLanguage": "en",
    "version": "1.0",
    "strings": {
        "k": {"comment": "c", "localizations": {"fr": {"stringUnit": {"state": "translated", "value": "v"}}}},
        "p": {"localizations": {"en": {"variations": {"plural": {"other": {"stringUnit": {"state": "new", "value": "o"}}, "one": {"stringUnit": {"state": "stale", "value": "1"}}}}}}},
        "bare": {},
        "never": {"shouldTranslate": False},
    },
}


def test_apple_strings():
    (r,) = apple_strings.parse(STRINGS)
    assert r.language == "fr"
    assert [(e.id, e.text, e.comment, e.status) for e in r.entries] == [("a", "x %@", "/* note */", "translated"), ("b", "line\\n\\tnext", None, "translated"), ("d", "", "// c", "new")]
    assert apple_strings.parse(STRINGS.decode().encode("utf-16"))[0].entries[0].id == "a"
    again = apple_strings.parse(apple_strings.render([r]).encode())[0]
    assert [(e.id, e.text) for e in again.entries] == [(e.id, e.text) for e in r.entries]
    with pytest.raises(CatalogError):
        apple_strings.render([Resource("en", entries=[Entry("p", "plural", forms={"other": "x"})])])


def test_android():
    (r,) = android.parse(ANDROID, "en")
    assert [(e.id, e.kind, e.text, e.status, e.comment) for e in r.entries] == [
        ("a", "singular", "Hi you & me", "translated", "note"),
        ("b", "singular", "x\\n  y\\n    ", "do_not_translate", None),
        ("e", "empty", "", "new", None),
        ("p", "plural", None, "translated", None),
    ]
    assert r.entries[-1].forms == {"other": "%d", "one": "one"}
    out = android.render([r])
    assert out.index('quantity="one"') < out.index('quantity="other"') and 'name="e"' not in out
    for bad in (b"<resources><string>x</string></resources>", b'<resources><plurals name="p"><item quantity="some">x</item></plurals></resources>', b"<resources>"):
        with pytest.raises(CatalogError):
            android.parse(bad)


def test_android_details():
    (r,) = android.parse(b'<resources><string name="a">foo\n</string><string name="b">foo\n  </string><string name="c" translatable="TRUE">x</string></resources>')
    assert [(e.text, e.status) for e in r.entries] == [("foo\\n", "translated"), ("foo\\n    ", "translated"), ("x", "do_not_translate")]


def test_format_details():
    (r, _) = files.PARSERS["csv"](b"key,en,fr\na,,x\n")
    assert [(e.kind, e.text, e.status) for e in r.entries] == [("singular", "", "translated")]
    assert files.formats_match("csv", "android", None, "fr") and files.formats_match("strings", "android", "fr", "fr") and not files.formats_match("strings", "android", "fr", "de")


def test_string_catalog():
    found = {r.language: {e.id: e for e in r.entries} for r in string_catalog.parse(json.dumps(CATALOG).encode())}
    assert found["fr"]["k"].text == "v" and found["en"]["k"].text == "k" and found["en"]["k"].status == "new"
    assert found["en"]["p"].forms == {"other": "o", "one": "1"} and found["en"]["p"].status == "stale"
    assert found["fr"]["bare"].kind == "empty" and found["en"]["never"].status == "do_not_translate" and "never" not in found["fr"]
    again = string_catalog.parse(string_catalog.render(string_catalog.parse(json.dumps(CATALOG).encode())).encode())
    assert {r.language for r in again} == {"en", "fr"}


def test_xliff():
    text = """<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file original="App/L.strings" source-language="en" target-language="fr" datatype="plaintext"><body>
    <trans-unit id="b" resname="r"><source><![CDATA[<x>]]></source><target>y</target><note> n1 </note><note>n2</note></trans-unit><trans-unit id="a"><source>s</source></trans-unit></body></file></xliff>"""
    source, target = xliff.parse(text.encode())
    assert (source.language, target.language, source.domain) == ("en", "fr", "L")
    assert [(e.id, e.text, e.comment) for e in source.entries] == [("b", "<x>", "n1\n\nn2"), ("a", "s", None)]
    assert [(e.kind, e.status) for e in target.entries] == [("singular", "translated"), ("empty", "new")]
    again = xliff.parse(xliff.render([source, target]).encode())
    assert [e.id for e in again[0].entries] == ["a", "b"] and again[1].entries[1].text == "y"
    for bad in (text.replace("1.2", "2.0", 1), text.replace("<source>s", "<source>s<g>t</g>"), text.replace(' target-language="fr"', ""), text.replace('id="a"', 'id="b"'), text.replace("L.strings", "L.stringsdict")):
        with pytest.raises(CatalogError):
            xliff.parse(bad.encode())


def test_tables():
    assert tables.parse_table('key,en,fr\na,"x, ""y""",z\n', ",") == [("en", [("a", 'x, "y"')]), ("fr", [("a", "z")])]
    assert tables.parse_table("a\tb\n", "\t") == [("default", [("a", "b")])]
    assert tables.parse_table("KEY,value\na,b\n", ",") == [("value", [("a", "b")])]
    for bad in ("a\nb\n", "key,en,fr\na,b\n"):
        with pytest.raises(CatalogError):
            tables.parse_table(bad, ",")


def test_json_maps():
    found = json_maps.parse_array(b'[{"key": "k", "en": "a"}, {"en": "b", "fr": "c"}, {"key": "k", "en": "d"}]')
    assert [(r.language, [(e.id, e.text) for e in r.entries]) for r in found] == [("en", [("k", "d"), ("b", "b")]), ("fr", [("b", "c")])]
    assert json_maps.parse_map(b'{"fr": "x", "en": "y"}')[0].entries[0].id == "y"
    assert json_maps.parse_yaml(b"en: a\nfr: b\n")[1].language == "fr"
    whole = [Resource("en", "d", {"x": "y"}, [Entry("a", "plural", None, {"one": "1", "other": "o"}, "pid", "c", "stale"), Entry("b", "empty", "")])]
    assert json_maps.parse_resources(json_maps.render_resources(whole).encode()) == whole
    for bad in (b"[]", b"{", b'[{"metadata": {"language": "en"}}]'):
        with pytest.raises(CatalogError):
            json_maps.parse_resources(bad)
    with pytest.raises(CatalogError):
        json_maps.parse_map(b'{"en": 1}')


def test_formats():
    assert files.format_of("x/STRINGS.XML") == "android" and files.format_of("a.json", b" [{") == "json_array" and files.format_of("a.json", b"{}") == "json_map"
    assert files.named_format("JSON-Array") == "json_array"
    with pytest.raises(CatalogError):
        files.format_of("a.txt")
    with pytest.raises(CatalogError):
        files.parse_file("odd.strings", b"", strict=True)


KEY = st.from_regex(r"[a-z][a-z0-9_]{0,15}", fullmatch=True)
TEXT = st.text("ABCxyz019 _-.,!?é\"'&<>", min_size=1, max_size=30).filter(lambda t: t.strip() == t and "\\" not in t)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(KEY, st.tuples(TEXT, TEXT), min_size=1, max_size=7))
def test_round_trips(catalog):
    both = [Resource(name, "d", {"source_language": "en", "version": "1.0"}, [Entry(k, "singular", v[n], status="translated") for k, v in sorted(catalog.items())]) for n, name in enumerate(("en", "fr"))]
    want = {r.language: {e.id: e.text for e in r.entries} for r in both}
    show = lambda resources: {r.language: {e.id: e.text for e in r.entries} for r in resources}
    for format in ("csv", "tsv", "xcstrings", "xliff", "resources"):
        assert show(files.PARSERS[format](files.RENDERERS[format](both).encode())) == want, format
    assert show(android.parse(android.render(both[:1]).encode(), "en")) == {"en": want["en"]}
    quoted = apple_strings.parse(apple_strings.render(both[:1]).encode())[0]
    assert {e.id: e.text.replace('\\"', '"') for e in quoted.entries} == want["en"]


def test_spark_conversion(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "values-fr").mkdir(parents=True)
    (folder / "values").mkdir()
    (folder / "values" / "strings.xml").write_bytes(b'<resources><string name="a">x</string><string name="b">y</string></resources>')
    (folder / "values-fr" / "strings.xml").write_bytes('<resources><string name="a">é</string></resources>'.encode())
    paths = files.expand([str(folder / "**" / "*.xml")])
    resources, entries = files.read_catalog(spark, paths)
    assert sorted((r["language"], r["id"], r["text"]) for r in entries.collect()) == [("en", "a", "x"), ("en", "b", "y"), ("fr", "a", "é")]
    (csv,) = files.write_catalog(resources, entries, str(tmp_path / "out"), "csv")
    assert open(csv, encoding="utf-8").read() == "key,en,fr\na,x,é\nb,y,\n"
    assert len(files.convert(spark, paths, str(tmp_path / "apple"), "strings")) == 2
    files.save_snapshot(resources, entries, str(tmp_path / "snap"))
    assert files.load_snapshot(spark, str(tmp_path / "snap"))[1].count() == 3


def test_streaming(spark, tmp_path):
    from loomglot.streaming.ingest import entry_stream, keep_merged, merged_table

    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "one.csv").write_text("key,en,fr\na,x,y\n")
    keep_merged(entry_stream(spark, str(folder), "*.csv"), str(tmp_path / "table"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    (folder / "two.csv").write_text("key,en,fr\na,z,y\nb,q,r\n")
    keep_merged(entry_stream(spark, str(folder), "*.csv"), str(tmp_path / "table"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = merged_table(spark, str(tmp_path / "table"))
    assert {(r["language"], r["id"]): r["text"] for r in rows.collect()} == {("en", "a"): "z", ("fr", "a"): "y", ("en", "b"): "q", ("fr", "b"): "r"}
    assert [p.name for p in (tmp_path / "table").iterdir()] == ["run-1-2"]
    (folder / "three.csv").write_text("key,en,fr\nb,new,r\n")
    keep_merged(entry_stream(spark, str(folder), "*.csv"), str(tmp_path / "table"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {p.name for p in (tmp_path / "table").iterdir()} == {"run-1-2", "run-3-3"}
    assert {(r["language"], r["id"]): r["text"] for r in merged_table(spark, str(tmp_path / "table")).collect()}[("en", "b")] == "new"


def test_ignore_files(tmp_path):
    for name in ("a.csv", "b.csv", "out/c.csv", "deep/d.csv", "deep/keep.csv", "deep/x/e.tsv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("key,en\n")
    (tmp_path / ".gitignore").write_text("# made\nout/\nb.*\n/deep/*.csv\n")
    (tmp_path / "deep" / ".ignore").write_text("!keep.csv\n")
    found = [p.removeprefix(f"{tmp_path}/") for p in files.expand([f"{tmp_path}/**/*.{{csv,tsv}}", f"{tmp_path}/b.csv"])]
    assert found == ["a.csv", "deep/keep.csv", "deep/x/e.tsv", "b.csv"]


def test_provenance(spark, tmp_path):
    (tmp_path / "t.csv").write_text("key,en,fr\nk,a,b\n")
    resources, entries = files.read_catalog(spark, [str(tmp_path / "t.csv")], provenance=True)
    rows = {r["language"]: r["custom"] for r in resources.collect()}
    assert rows["fr"]["provenance.source_path"] == str(tmp_path / "t.csv") and rows["fr"]["provenance.source_format"] == "csv" and rows["en"]["provenance.source_language"] == "en"
    assert entries.count() == 2


def test_string_catalogs_in_pieces(spark, monkeypatch):
    """Pieces make up the file that is rendered whole, and are read as the whole file is, for keys in any order."""
    monkeypatch.setattr(files, "PIECE", 300)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    data = json.loads(json.dumps(CATALOG))
    data["strings"] |= {f"many {k} é": {"localizations": {"de": {"stringUnit": {"state": "new", "value": f"a {k}\n"}}}} if k % 3 else {"shouldTranslate": k % 2 == 0} for k in range(40)}
    whole = json.dumps(data, ensure_ascii=False, sort_keys=True)
    for text in (whole, json.dumps(data), '{"strings": {"b": {}, "a": {}, "b": {"comment": "x"}}, "sourceLanguage": "fr"}', '{"sourceLanguage": "fr", "strings": {}, "version": "2"}', '{"strings": {"a": {}}}'):
        pieces = [("x/T.xcstrings", k, text[a : a + 7]) for k, a in enumerate(range(0, len(text), 7))]
        a = files.parsed_pieces(spark.createDataFrame(pieces, "path string, piece long, content string").repartition(4))
        b = files.parsed(spark.createDataFrame([("x/T.xcstrings", text.encode())], "path string, content binary"), keep=False)
        for one, two in zip(a, b):
            assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    resources, entries = files.parsed(spark.createDataFrame([("x/T.xcstrings", whole.encode())], "path string, content binary"), keep=False)
    for rows in (entries, entries.limit(0)):
        found = files.rendered_pieces(resources, rows).orderBy("path", "piece").collect()
        assert "".join(r["content"] for r in found) == files.rendered(resources, rows, "xcstrings").first()["content"]
        assert len(found) > 3 or not rows.count()
    for text in ('{"strings": {"a": {}', '{"strings": {"a": {}}} x', '{"strings" {}}'):
        with pytest.raises(CatalogError):
            string_catalog.survey(iter([text[:4], text[4:]]))
