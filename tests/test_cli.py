import json

from loomglot.cli import main
from loomglot.sources.builder import CatalogBuilder


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_commands(spark, tmp_path, capsys):
    a, b, out = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "out"
    a.write_text("key,en,fr\nk,Hello %@,Bonjour\nonly,x,\n")
    b.write_text("key,en,fr\nk,Hallo,Bonjour\nmore,y,z\n")
    assert main(["stats", str(a)]) == 0
    assert [x["total"] for x in lines(capsys)[:2]] == [2, 2]
    assert main(["diff", str(a), str(b)]) == 0
    assert {(x["id"], x["change"]) for x in lines(capsys) if "change" in x} == {("k", "changed"), ("only", "added"), ("more", "removed")}
    assert main(["view", str(a), "--language", "fr", "--keys-only"]) == 0
    assert lines(capsys) == [{"language": "fr", "id": "k"}, {"language": "fr", "id": "only"}]
    assert main(["validate", str(a)]) == 1
    assert any(x.get("signatures") == 2 for x in lines(capsys))
    assert main(["sync", str(a), str(b), "--output", str(out), "--format", "csv", "--name", "b.csv"]) == 0
    assert (out / "b.csv").read_text() == "key,en,fr\nk,Hello %@,Bonjour\nmore,y,z\n"
    assert main(["merge", str(a), str(b), "--output", str(out), "--format", "xcstrings"]) == 0
    assert set(json.loads((out / "catalog.xcstrings").read_text())["strings"]) == {"k", "only", "more"}
    assert main(["normalize", str(a), "--output", str(out), "--format", "tsv"]) == 0
    assert "Hello %s" in (out / "catalog.tsv").read_text()
    assert main(["edit", str(a), "--key", "k", "--text", "Hi", "--language", "en", "--output", str(out), "--format", "resources"]) == 0
    assert main(["convert", str(a), "--include", "fr", "--output", str(out), "--format", "android"]) == 0
    assert (out / "fr.xml").exists() and not (out / "en.xml").exists()
    lines(capsys)
    assert main(["view", str(a), "--language", "fr", "--keys-only", "--summary"]) == 0
    assert lines(capsys)[0] == {"total_matches": 2, "languages": ["fr"], "statuses": {"translated": 2}}
    assert main(["translate", str(a), "--source", "en", "--targets", "de", "--backend", "operator:add", "--output", str(out), "--format", "csv", "--name", "t.csv"]) == 0
    assert lines(capsys) == [{"reason": "job", "n": 2}]
    assert (out / "t.csv").read_text() == "key,de,en,fr\nk,Hello %@de,Hello %@,Bonjour\nonly,xde,x,\n"
    assert main(["annotate", str(a), "--backend", "operator:add", "--output", str(out), "--format", "xcstrings", "--name", "n.xcstrings"]) == 0
    assert json.loads((out / "n.xcstrings").read_text())["strings"]["only"]["comment"] == "xen"
    assert main(["merge", str(a), "--strategy", "odd", "--output", str(out), "--format", "csv"]) == 2


def test_builder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,en\nk,v\n")
    (tmp_path / "b.tsv").write_text("key\ten\nk\tw\n")
    resources, entries = CatalogBuilder(spark).add_files([str(tmp_path / "{a,b}.*")]).add_file(str(tmp_path / "a.csv"), language="en").build()
    assert resources.count() == 3 and [r["text"] for r in entries.orderBy("resource_ord").collect()] == ["v", "w", "v"]
