import random
import re

import pytest
from pyspark.sql import functions as F

from loomglot.functions import keys, languages, placeholders, plurals, texts
from loomglot.operators import checks, diff, edit, merge, normalize, plan, select, sync
from loomglot.schema import CatalogError, as_entries


def entries(spark, *rows, schema="resource_ord long, entry_ord long, language string, id string, text string, status string"):
    return as_entries(spark.createDataFrame(list(rows), schema))


def values(spark, texts_, expression):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts_)], "k long, t string").select("k", expression(F.col("t")).alias("v"))
    return [r["v"] for r in df.orderBy("k").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [("Hello %1$@, you have %2$d items and %s extra", ["1$s", "2$d", "s"]), ("Discount: 50%% and value %d", ["d"]), ("Value: %@ and number %ld", ["s", "d"]), ("%5d %.2f 50%off %llu", ["o", "u"]), ("", [])],
)
def test_signature(spark, text, expected):
    assert values(spark, [text], placeholders.signature) == [expected]


def scan(text):
    """Placeholders by a hand-written scan."""
    out, k = [], 0
    while k < len(text):
        if text[k] != "%":
            k += 1
        elif text[k + 1 : k + 2] == "%":
            k += 2
        else:
            m = re.match(r"%([0-9]+\$)?l{0,2}", text[k:])  # the l are taken first, whatever follows
            end = k + len(m[0])
            if end < len(text) and (text[end].isascii() and text[end].isalpha() or text[end] == "@"):
                out.append(text[k : end + 1])
                k = end
            k += 1
    return out


def test_tokens_against_scan(spark):
    rnd = random.Random(1)
    found = ["".join(rnd.choice("%%%l1$@sd x2") for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    assert values(spark, found, placeholders.tokens) == [scan(t) for t in found]


def test_key_styles(spark):
    names = ["HelloWorld", "HTMLParser2Go", "already_snake", "kebab-case key", "", "***", "éCole你"]
    assert values(spark, names, keys.snake) == ["hello_world", "html_parser2_go", "already_snake", "kebab_case_key", "", "***", "é_cole你"]
    assert values(spark, names[:2], keys.kebab) == ["hello-world", "html-parser2-go"]
    assert values(spark, names[:4], keys.camel) == ["helloWorld", "htmlParser2Go", "alreadySnake", "kebabCaseKey"]
    with pytest.raises(ValueError):
        keys.styled(F.col("x"), "loud")


@pytest.mark.parametrize(
    "path, expected",
    [("a/fr.lproj/Localizable.strings", "fr"), ("res/values/strings.xml", "en"), ("res/values-zh-rCN/strings.xml", "zh-CN"), ("res/values-b+zh+Hans+CN/s.xml", "zh-Hans-CN"), ("x/de.strings", "de"), ("x/pt-BR.strings", "pt-BR"), ("pt_BR.lproj/x", "pt-BR"), ("x/other.strings", None)],
)
def test_language_of_path(spark, path, expected):
    assert languages.language_of_path(path) == expected
    assert values(spark, [path], languages.language_from_path) == [expected]


def test_plurals_and_texts(spark):
    required = values(spark, ["en", "ru", "ja", "ar-EG", "xx"], plurals.required)
    assert required == [["one", "other"], ["one", "few", "many", "other"], ["other"], ["zero", "one", "two", "few", "many", "other"], ["other"]]
    assert values(spark, ["  <b>a</b>\n   b \r\n c\n"], texts.plain_text) == ["a\\nb \\nc"]
    assert values(spark, ["a\tb", "a\tb\nc"], texts.escaped_newlines) == ["a\tb", "a\\tb\\nc"]
    assert values(spark, ["Needs-Review", "x"], texts.parsed_status) == ["needs_review", None]
    assert values(spark, ["/* a b */", "// c", "d"], texts.clean_comment) == ["a b", "c", "d"]
    assert values(spark, ["abcdef"], lambda c: texts.truncated(c, 3)) == ["abc..."]
    assert values(spark, ['```json\n{"translation": "x"}\n```', '{"translation": "y"}'], lambda c: texts.reply_field(c, "translation")) == ["x", "y"]


def test_merge_skip_drops_all_copies(spark):
    rows = entries(spark, (0, 0, "en", "k", "a", "new"), (1, 0, "en", "k", "b", "new"), (2, 0, "en", "k", "c", "new"), (2, 1, "en", "x", "d", "new"), (3, 0, "fr", "k", "e", "new"), (3, 1, "fr", "k", "f", "new"))
    show = lambda s: sorted((r["language"], r["id"], r["text"]) for r in merge.merge(rows, s).collect())
    single = [("fr", "k", "e"), ("fr", "k", "f")]
    assert show("skip") == [("en", "x", "d"), *single]
    assert show("first") == [("en", "k", "a"), ("en", "x", "d"), *single]
    assert show("last") == [("en", "k", "c"), ("en", "x", "d"), *single]
    with pytest.raises(CatalogError):
        merge.merge(rows, "none")


def test_diff_direction(spark):
    a = entries(spark, (0, 0, "en", "same", "x", "new"), (0, 1, "en", "mine", "x", "new"))
    b = entries(spark, (0, 0, "EN", "same", "x", "translated"), (0, 1, "EN", "yours", "x", "new"))
    assert diff.summary(diff.diff(a, b, "en_US")).first().asDict() == {"language": "en", "added": 1, "removed": 1, "changed": 0, "unchanged": 1}


def test_sync(spark):
    source = entries(spark, (0, 0, "en", "k", "Hello", "new"), (1, 0, "fr", "k", "Bonjour", "new"), (0, 1, "en", "m1", "Twice", "new"), (0, 2, "en", "m2", "Twice", "new"))
    target = entries(spark, (0, 0, "en", "k", "old", "translated"), (1, 0, "fr-CA", "Hello", "vieux", "new"), (0, 1, "en", "nothing", "y", "new"), (0, 2, "en", "Twice", "z", "new"), (2, 0, "de", "k", "alt", "new"))
    out = {(r["language"], r["id"]): (r["how"], r["outcome"], r["text"], r["status"]) for r in sync.sync(source, target, provenance="here").collect()}
    assert out[("en", "k")] == ("exact", "updated", "Hello", "translated")
    assert out[("fr-CA", "Hello")] == ("fallback", "updated", "Bonjour", "new")
    assert out[("en", "nothing")][:2] == ("none", "unmatched")
    assert out[("en", "Twice")][:2] == ("ambiguous", "ambiguous")
    assert out[("de", "k")][:2] == ("exact", "missing_language")
    with pytest.raises(CatalogError, match="ambiguous"):
        sync.fail_on(sync.resolve(source, target))


def test_stats_and_checks(spark):
    rows = entries(spark, (0, 0, "en", "a", "x", "translated"), (0, 1, "en", "b", "y", "do_not_translate"), (0, 2, "en", "c", "", "new"))
    got = checks.stats(rows).first()
    assert (got["translated"], got["do_not_translate"], got["new"], got["completion"]) == (1, 1, 1, 50.0)
    plural = as_entries(spark.createDataFrame([(0, 0, "en", "p", "plural", {"other": "%d x"}, "translated")], "resource_ord long, entry_ord long, language string, id string, kind string, forms map<string,string>, status string"))
    assert checks.plural_issues(plural).first()["missing"] == ["one"]
    fixed = checks.autofix_plurals(plural).first()
    assert fixed["forms"] == {"one": "%d x", "other": "%d x"} and fixed["status"] == "needs_review" and fixed["added"] == 1
    mixed = entries(spark, (0, 0, "en", "a", "%d", "new"), (1, 0, "fr", "a", "%s", "new"), (0, 1, "en", "b", "%1$@", "new"), (1, 1, "fr", "b", "%1$s", "new"))
    assert [r["id"] for r in checks.placeholder_issues(mixed).collect()] == ["a"]
    resources = mixed.select("resource_ord", "language").distinct()
    checks.validate(resources, mixed)
    with pytest.raises(CatalogError, match="empty_resource"):
        checks.validate(resources.unionByName(spark.createDataFrame([(9, "de")], "resource_ord long, language string")), mixed)


def test_normalize(spark):
    rows = entries(spark, (0, 0, "en", "zKey", "%@", "new"), (0, 1, "en", "aKey", "%d", "new"))
    out = normalize.normalize_strict(rows, "snake").orderBy("entry_ord").collect()
    assert [(r["id"], r["text"], r["changed"]) for r in out] == [("a_key", "%d", True), ("z_key", "%s", True)]
    again = normalize.normalize(as_entries(normalize.normalize(rows, "snake")), "snake")
    assert not again.agg(F.bool_or("changed")).first()[0]
    with pytest.raises(CatalogError, match="share the key"):
        normalize.normalize_strict(entries(spark, (0, 0, "en", "aKey", "", "new"), (0, 1, "en", "a-key", "", "new")), "snake")


def test_plan_and_apply(spark):
    rows = entries(spark, (0, 0, "en", "a", "Hi", "translated"), (0, 1, "en", "b", " ", "translated"), (0, 2, "en", "c", "No", "do_not_translate"), (1, 0, "fr", "a", "Salut", "translated"))
    jobs = plan.translation_plan(select.by_language(rows, "en"), rows, ["fr", "de"])
    assert sorted((r["id"], r["language"], r["reason"]) for r in jobs.collect())[:2] == [("a", "de", None), ("a", "fr", "status")]
    done = plan.run_jobs(jobs, lambda text, language: f"{language}:{text}", workers=2)
    out = plan.apply_results(rows, done, jobs)
    assert {(r["language"], r["id"]): r["text"] for r in out.collect()}[("de", "a")] == "de:Hi"
    with pytest.raises(CatalogError, match="failed"):
        plan.apply_results(rows, plan.run_jobs(jobs, lambda t, l: 1 / 0), jobs)


def test_annotations_and_pull(spark):
    schema = "resource_ord long, entry_ord long, language string, id string, text string, status string, comment string"
    rows = entries(spark, (0, 0, "en", "a", "Hi", "new", None), (0, 1, "en", "b", "Ho", "new", "by hand"), (1, 0, "fr", "a", "x", "new", ""), schema=schema)
    assert [(r["id"], r["text"]) for r in plan.annotation_targets(rows).collect()] == [("a", "Hi")]
    noted = plan.apply_annotations(rows, spark.createDataFrame([("a", "note")], "id string, comment string"))
    assert {r["comment"] for r in noted.filter("id = 'a'").collect()} == {"note"}
    with pytest.raises(CatalogError):
        plan.apply_annotations(rows, spark.createDataFrame([("zz", "note")], "id string, comment string"))
    remote = entries(spark, (0, 0, "EN", "a", "New", "new"), (0, 1, "de", "a", "Neu", "new"), (0, 2, "en", "q", "?", "new"), (0, 3, "en", "b", "", "new"))
    # An entry is met in exactly its language: "EN" is one that the catalog lacks.
    assert {(r["language"], r["id"]): r["action"] for r in plan.pull(rows, remote).collect()} == {("EN", "a"): "insert", ("de", "a"): "insert", ("en", "q"): "unknown", ("en", "b"): "empty"}


def test_edits_and_selections(spark):
    rows = entries(spark, (0, 0, "en", "a", "x", "new"), (1, 0, "fr", "b", "", "new"))
    out = edit.set_value(edit.add(rows, "de", "n", "neu"), "en", "a", "y", "stale")
    assert sorted((r["language"], r["id"], r["text"], r["status"]) for r in out.collect()) == [("de", "n", "neu", "new"), ("en", "a", "y", "stale"), ("fr", "b", "", "new")]
    assert edit.set_value(rows, "en", "a", "").count() == 1 and edit.remove(rows, None, "b").count() == 1
    with pytest.raises(CatalogError):
        edit.update(rows, "en", "zz", "t")
    assert sorted((r["id"], r["language"]) for r in select.missing_translations(rows).collect()) == [("a", "fr"), ("b", "en"), ("b", "fr")]
    assert select.search(rows, "A", missing_only=True).count() == 1
    assert select.union_all(rows, rows).select("resource_ord").distinct().count() == 4
    with pytest.raises(CatalogError):
        select.parse_statuses(" , ")


def test_empty_catalog(spark):
    none = entries(spark).limit(0)
    for df in (merge.merge(none), diff.diff(none, none), sync.sync(none, none), checks.stats(none), normalize.normalize(none, "camel"), select.missing_translations(none), plan.translation_plan(none, none, ["fr"])):
        assert df.count() == 0
