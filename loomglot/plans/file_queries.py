"""Queries over files: contents made from the benchmark tables are parsed, catalogs rendered, and both converted, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages, texts
from ..operators import edit, plan, select
from ..schema import TEXT_MAP, as_entries
from ..sources import files
from .catalogs import derived
from .registry import query


def contents(spark, sf_dir: str, table: str, path: str, line: str, order: str, head: str = "", tail: str = "", separator: str = "\n") -> DataFrame:
    """``path, content``: a file for each ``path``, of the lines of its rows; all are SQL expressions over the table."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(path).alias("path"), F.struct(F.expr(order).alias("o"), F.expr(line).alias("l")).alias("x"))
    lines = rows.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["l"]), separator)
    return lines.select("path", F.concat(F.lit(head), body, F.lit(tail)).cast("binary").alias("content"))


def resources_of(entries: DataFrame, **custom: str) -> DataFrame:
    """The resources that entries belong to."""
    own = F.create_map(*(F.lit(x) for pair in custom.items() for x in pair)) if custom else F.create_map().cast(TEXT_MAP)
    return entries.groupBy("resource_ord").agg(F.min("language").alias("language"), F.lit("").alias("domain")).select("*", own.alias("custom"), F.lit(None).cast("string").alias("source_path"))


def converted(entries: DataFrame, format: str, **custom: str) -> DataFrame:
    """Entries written in a format and read back."""
    if format == "xcstrings":  # all languages are one file, which no task holds whole
        return files.parsed_pieces(files.rendered_pieces(resources_of(entries, **custom), entries))[1]
    out = files.rendered(resources_of(entries, **custom), entries, format, "x/{language}.lproj/t." + {"android": "xml", "resources": "resources"}.get(format, format) if format in files.SINGLE else None)
    return files.parsed(out.select("path", F.col("content").cast("binary").alias("content")), format, keep=False)[1]


_C = "'customer_' || CAST(c_custkey AS STRING)"
_SQL_ROWS = " SELECT language, row_number() OVER (PARTITION BY part ORDER BY {order}) - 1 AS entry_ord, id, kind, text, comment, status FROM ({rows}) q"


@query(_SQL_ROWS.format(order="k", rows="""SELECT c_nationkey AS part, c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'pt-BR' END AS language, 'customer_' || c_custkey AS id, 'singular' AS kind,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN c_name || '\\n\\tnext' ELSE c_name || ' %@ \\"' || c_mktsegment || '\\"' END AS text, CASE WHEN c_custkey % 2 = 1 THEN '/* ' || c_mktsegment || ' */' END AS comment,
  CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'translated' END AS status FROM customer"""))
def read_strings(spark, sf_dir):
    path = "concat('app/', CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'pt_BR' END, '.lproj/N', c_nationkey, '.strings')"
    value = r"""CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN concat(c_name, '\n\tnext') ELSE concat(c_name, ' %@ \\"', c_mktsegment, '\\"') END"""
    line = f"""concat(CASE WHEN c_custkey % 2 = 1 THEN concat('/* ', c_mktsegment, ' */\n') ELSE '' END, '"', {_C}, '" = "', {value}, '";\nno pair in this line')"""
    return files.parsed(contents(spark, sf_dir, "customer", path, line, "c_custkey", "//: made by a tool\n// for a test\n\n"), keep=False)[1].select("language", "entry_ord", "id", "kind", "text", "comment", "status")


@query(_SQL_ROWS.format(order="kind = 'plural', k", rows="""SELECT c_nationkey AS part, c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'zh-CN' END AS language, 'customer_' || c_custkey AS id,
  CASE WHEN c_custkey % 4 = 0 THEN 'plural' WHEN c_custkey % 5 = 0 THEN 'empty' ELSE 'singular' END AS kind,
  CASE WHEN c_custkey % 4 = 0 THEN '1 ' || c_name || '|%d & ' || c_name WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || ' & bold\\n    ' END AS text, c_mktsegment AS comment,
  CASE WHEN c_custkey % 3 = 1 THEN 'do_not_translate' WHEN c_custkey % 3 = 2 THEN 'translated' WHEN c_custkey % 4 <> 0 AND c_custkey % 5 = 0 THEN 'new' ELSE 'translated' END AS status FROM customer"""))
def read_android(spark, sf_dir):
    path = "concat('res/', CASE c_nationkey % 3 WHEN 0 THEN 'values' WHEN 1 THEN 'values-fr' ELSE 'values-zh-rCN' END, '/n', c_nationkey, '.xml')"
    head = f"""' name="', {_C}, '"', CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' translatable="TRUE"' ELSE ' translatable="true"' END, '>'"""
    text = "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_name, ' &amp; <b>bold</b>\n  ') END"
    plural = "concat('<item quantity=\"OTHER\">%d &amp; ', c_name, '</item><item quantity=\"one\">1 ', c_name, '</item></plurals>')"
    line = f"concat('<!-- ', c_mktsegment, ' -->', CASE WHEN c_custkey % 4 = 0 THEN concat('<plurals', {head}, {plural}) ELSE concat('<string', {head}, {text}, '</string><string name=\"gone\"/>') END)"
    rows = files.parsed(contents(spark, sf_dir, "customer", path, line, "c_custkey", "<resources>", "</resources>"), keep=False)[1]
    shown = F.when(F.col("kind") == "plural", F.concat_ws("|", F.element_at("forms", F.lit("one")), F.element_at("forms", F.lit("other")))).otherwise(F.col("text"))
    return rows.select("language", "entry_ord", "id", "kind", shown.alias("text"), "comment", "status")


@query("""WITH c AS (SELECT c_custkey % 3 AS part, c_custkey % 4 AS sort, 'customer_' || c_custkey AS id, c_name AS name, c_mktsegment AS comment FROM customer)
SELECT part, 'fr' AS language, id, 'singular' AS kind, name AS text, comment, 'translated' AS status FROM c WHERE sort = 0
UNION ALL SELECT part, 'de', id, 'plural', 'one=1 ' || name || ' | other=%d ' || name, comment, 'stale' FROM c WHERE sort = 3
UNION ALL SELECT part, 'en', id, 'singular', id, comment, 'new' FROM c WHERE sort IN (0, 3)
UNION ALL SELECT part, l, id, 'empty', '', comment, 'new' FROM c CROSS JOIN (SELECT unnest(['en', 'fr', 'de']) AS l) x WHERE sort = 1
UNION ALL SELECT part, 'en', id, 'empty', '', comment, 'do_not_translate' FROM c WHERE sort = 2""")
def read_xcstrings(spark, sf_dir):
    own = """CASE c_custkey % 4 WHEN 0 THEN concat('"localizations":{"fr":{"stringUnit":{"state":"translated","value":"', c_name, '"}}},')
      WHEN 2 THEN '"shouldTranslate":false,'
      WHEN 3 THEN concat('"localizations":{"de":{"variations":{"plural":{"other":{"stringUnit":{"state":"new","value":"%d ', c_name, '"}},"one":{"stringUnit":{"state":"stale","value":"1 ', c_name, '"}}}}}},') ELSE '' END"""
    line = f"""concat('"', {_C}, '":{{', {own}, '"comment":"', c_mktsegment, '"}}')"""
    data = contents(spark, sf_dir, "customer", "concat('p', c_custkey % 3, '.xcstrings')", line, "c_custkey", '{"sourceLanguage":"en","version":"1.0","strings":{', "}}", ",")
    resources, rows = files.parsed(data, keep=False)
    part = F.regexp_extract("source_path", "p([0-9])", 1).cast("bigint").alias("part")
    rows = rows.join(resources.select("resource_ord", part), "resource_ord")
    return rows.select("part", "language", "id", "kind", texts.value_text(F.col("kind"), F.col("text"), F.col("forms")).alias("text"), "comment", "status")


@query("""SELECT 'N' || c_nationkey AS domain, 'en' AS language, 'customer_' || c_custkey AS id, 'singular' AS kind, c_name || ' <x> & y' AS text, CASE WHEN c_custkey % 2 = 0 THEN 'first' || chr(10) || chr(10) || c_mktsegment END AS comment, 'translated' AS status FROM customer
UNION ALL SELECT 'N' || c_nationkey, 'fr', 'customer_' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'empty' ELSE 'singular' END, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'nom ' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'first' || chr(10) || chr(10) || c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'translated' END FROM customer""")
def read_xliff(spark, sf_dir):
    note = "CASE WHEN c_custkey % 2 = 0 THEN concat('<note> first </note><note>', c_mktsegment, '</note>') ELSE '' END"
    target = "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('<target>nom ', c_custkey, '</target>') END"
    unit = f"""concat('<trans-unit id="', {_C}, '"><source>', c_name, '<![CDATA[ <x>]]> &amp; y</source>', {target}, {note}, '</trans-unit>')"""
    whole = contents(spark, sf_dir, "customer", "concat('n', c_nationkey, '.xliff')", unit, "c_custkey")
    number = F.regexp_extract("path", "n([0-9]+)", 1)
    head = F.concat(F.lit('<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file original="App/N'), number, F.lit('.strings" source-language="en" target-language="fr" datatype="plaintext"><body>'))
    whole = whole.select("path", F.concat(head, F.col("content").cast("string"), F.lit("</body></file></xliff>")).cast("binary").alias("content"))
    return files.parsed(whole, keep=False)[1].select("domain", "language", "id", "kind", "text", "comment", "status")


_WIDE = "SELECT language, 'customer_' || c_custkey AS id, 'singular' AS kind, CASE WHEN language = 'fr' AND c_custkey % 5 = 0 THEN '' WHEN language = 'fr' THEN 'nom, ' || c_custkey ELSE c_name || ' \"x\"' END AS text, 'translated' AS status FROM customer CROSS JOIN (SELECT unnest(['en', 'fr']) AS language) l"


def _wide(spark, sf_dir, extension, sep):
    fr = f"CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('\"nom, ', c_custkey, '\"') END"
    line = f"concat({_C}, '{sep}', '\"', c_name, ' \"\"x\"\"', '\"', '{sep}', {fr})"
    data = contents(spark, sf_dir, "customer", f"concat('n', c_nationkey, '.{extension}')", line, "c_custkey", sep.join(["key", "en", "fr"]) + "\n", "\n")
    return files.parsed(data, keep=False)[1].select("language", "id", "kind", "text", "status")


@query(_WIDE)
def read_csv(spark, sf_dir):
    return _wide(spark, sf_dir, "csv", ",")


@query(_WIDE)
def read_tsv(spark, sf_dir):
    return _wide(spark, sf_dir, "tsv", "\t")


@query("SELECT 'default' AS language, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS entry_ord, 'customer_' || c_custkey AS id, c_name AS text FROM customer")
def read_csv_without_header(spark, sf_dir):
    data = contents(spark, sf_dir, "customer", "concat('n', c_nationkey, '.csv')", f"concat({_C}, ',', c_name)", "c_custkey")
    return files.parsed(data, keep=False)[1].select("language", "entry_ord", "id", "text")


@query("""SELECT 'en' AS language, 'N' || c_nationkey AS domain, 'customer_' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'singular' ELSE 'plural' END AS kind,
CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE 'one=1 | other=' || c_name END AS text, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS comment, 'needs_review' AS status FROM customer""")
def read_resources(spark, sf_dir):
    value = """CASE c_custkey % 3 WHEN 0 THEN '"Empty"' WHEN 1 THEN concat('{"Singular":"', c_name, '"}') ELSE concat('{"Plural":{"id":"x","forms":{"other":"', c_name, '","one":"1"}}}') END"""
    line = f"""concat('{{"id":"', {_C}, '","value":', {value}, ',"comment":', CASE WHEN c_custkey % 2 = 0 THEN concat('"', c_mktsegment, '"') ELSE 'null' END, ',"status":"Needs_Review","custom":{{}}}}')"""
    data = contents(spark, sf_dir, "customer", "concat('n', c_nationkey, '.json')", line, "c_custkey", "", "", ",")
    head = F.concat(F.lit('[{"metadata":{"language":"en","domain":"N'), F.regexp_extract("path", "n([0-9]+)", 1), F.lit('","custom":{}},"entries":['))
    data = data.select("path", F.concat(head, F.col("content").cast("string"), F.lit("]}]")).cast("binary").alias("content"))
    return files.parsed(data, keep=False)[1].select("language", "domain", "id", "kind", texts.value_text(F.col("kind"), F.col("text"), F.col("forms")).alias("text"), "comment", "status")


_MAPS = "SELECT language, id, CASE language WHEN 'en' THEN n_name ELSE 'nom ' || n_nationkey END AS text, 'needs_review' AS status FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'nation_' || n_nationkey ELSE n_name END AS id FROM nation) n CROSS JOIN (SELECT unnest(['en', 'fr']) AS language) l"
_KEY = """CASE WHEN n_nationkey % 2 = 0 THEN concat('"key":"nation_', n_nationkey, '",') ELSE '' END"""
_MAP = f"""concat('{{', {_KEY}, '"fr":"nom ', n_nationkey, '","en":"', n_name, '"}}')"""


@query(_MAPS)
def read_json_map(spark, sf_dir):
    return files.parsed(contents(spark, sf_dir, "nation", "concat('n', n_nationkey, '.json')", _MAP, "n_nationkey"), keep=False)[1].select("language", "id", "text", "status")


@query("SELECT n_regionkey AS region, m.*, CAST(row_number() OVER (PARTITION BY n_regionkey, language ORDER BY n_nationkey) - 1 AS STRING) AS place FROM (" + _MAPS.replace("SELECT language, id,", "SELECT n_nationkey AS k, language, id,", 1) + ") m JOIN nation ON k = n_nationkey")
def read_json_array(spark, sf_dir):
    resources, rows = files.parsed(contents(spark, sf_dir, "nation", "concat('r', n_regionkey, '.json')", _MAP, "n_nationkey", "[", "]", ","), keep=False)
    rows = rows.join(resources.select("resource_ord", F.regexp_extract("source_path", "r([0-9]+)", 1).cast("bigint").alias("region")), "resource_ord")
    number = F.coalesce(F.regexp_extract("id", "_([0-9]+)$", 1), F.lit("")).cast("bigint")
    return rows.select("region", number.alias("k"), "language", "id", "text", "status", F.element_at("custom", F.lit("array_index")).alias("place"))


@query(_MAPS)
def read_yaml_map(spark, sf_dir):
    line = """concat(CASE WHEN n_nationkey % 2 = 0 THEN concat('key: nation_', n_nationkey, '\n') ELSE '' END, 'fr: nom ', n_nationkey, '\nen: "', n_name, '"\n')"""
    return files.parsed(contents(spark, sf_dir, "nation", "concat('n', n_nationkey, '.yaml')", line, "n_nationkey"), keep=False)[1].select("language", "id", "text", "status")


_SINGULAR = "regexp_replace(replace(text, '%%', chr(1)), '%([0-9]+\\$)?l*s', '%\\1@', 'g')"


@query(" SELECT id, language, 'singular' AS kind, replace(" + _SINGULAR + ", chr(1), '%%') AS text, CASE WHEN text = '' THEN 'new' ELSE 'translated' END AS status FROM part_cat", "part_cat")
def convert_strings(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat"), "strings").select("id", "language", "kind", "text", "status")


@query(" SELECT id, language, kind, text, CASE WHEN status = 'do_not_translate' THEN status ELSE 'translated' END AS status FROM part_cat WHERE kind = 'singular'", "part_cat")
def convert_android(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat"), "android").select("id", "language", "kind", "text", "status")


@query(" SELECT id, language, 'singular' AS kind, replace(" + _SINGULAR + """, chr(1), '%%') AS text, status FROM part_cat WHERE kind = 'singular'
UNION ALL SELECT id, l, 'empty', '', 'new' FROM (SELECT DISTINCT id FROM part_cat WHERE kind = 'empty') e CROSS JOIN (SELECT unnest(['en', 'fr', 'de']) AS l) x""", "part_cat")
def convert_xcstrings(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat"), "xcstrings", source_language="en", version="1.0").select("id", "language", "kind", "text", "status")


@query(""" SELECT id, language, CASE WHEN text = '' THEN 'empty' ELSE 'singular' END AS kind, text, CASE WHEN text = '' THEN 'new' ELSE 'translated' END AS status FROM part_cat WHERE language <> 'de'
UNION ALL SELECT id, 'fr', 'empty', '', 'new' FROM part_cat WHERE language = 'en' AND id NOT IN (SELECT id FROM part_cat WHERE language = 'fr')""", "part_cat")
def convert_xliff(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat").filter("language <> 'de'"), "xliff", source_language="en").select("id", "language", "kind", "text", "status")


_TABLE = " SELECT k.id, l.language, 'singular' AS kind, coalesce(p.text, '') AS text, 'translated' AS status FROM (SELECT DISTINCT id FROM part_cat) k CROSS JOIN (SELECT DISTINCT language FROM part_cat) l LEFT JOIN part_cat p ON p.id = k.id AND p.language = l.language"


@query(_TABLE, "part_cat")
def convert_csv(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat"), "csv").select("id", "language", "kind", "text", "status")


@query(_TABLE, "part_cat")
def convert_tsv(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat"), "tsv").select("id", "language", "kind", "text", "status")


@query(" SELECT id, language, kind, text, status FROM part_cat", "part_cat")
def convert_resources(spark, sf_dir):
    return converted(derived(spark, sf_dir, "part_cat"), "resources").select("id", "language", "kind", "text", "status")


@query(" SELECT id, language, status, categories AS forms FROM plural_cat", "plural_cat")
def convert_plurals(spark, sf_dir):
    rows = converted(derived(spark, sf_dir, "plural_cat"), "resources")
    return rows.select("id", "language", "status", F.array_join(F.filter(F.array(*map(F.lit, ("zero", "one", "two", "few", "many", "other"))), lambda c: F.map_contains_key("forms", c)), ",").alias("forms"))


def _written(spark, sf_dir, format, rows=None):
    rows = derived(spark, sf_dir, "part_cat") if rows is None else rows
    return files.rendered(resources_of(rows), rows, format).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query(""", w AS (SELECT id, max(text) FILTER (language = 'de') AS de, max(text) FILTER (language = 'en') AS en, max(text) FILTER (language = 'fr') AS fr FROM part_cat GROUP BY id)
SELECT 'catalog.csv' AS path, sha256('key,de,en,fr' || chr(10) || string_agg(id || ',' || coalesce(de, '') || ',' || coalesce(en, '') || ',' || coalesce(fr, '') || chr(10), '' ORDER BY id)) AS content FROM w""", "part_cat")
def write_csv(spark, sf_dir):
    return _written(spark, sf_dir, "csv")


@query(""", w AS (SELECT id, max(text) FILTER (language = 'de') AS de, max(text) FILTER (language = 'en') AS en, max(text) FILTER (language = 'fr') AS fr FROM part_cat GROUP BY id)
SELECT 'catalog.tsv' AS path, sha256('key' || chr(9) || 'de' || chr(9) || 'en' || chr(9) || 'fr' || chr(10) || string_agg(id || chr(9) || coalesce(de, '') || chr(9) || coalesce(en, '') || chr(9) || coalesce(fr, '') || chr(10), '' ORDER BY id)) AS content FROM w""", "part_cat")
def write_tsv(spark, sf_dir):
    return _written(spark, sf_dir, "tsv")


@query(" SELECT language || '.strings' AS path, sha256('//: Language: ' || language || chr(10) || chr(10) || string_agg('\"' || id || '\" = \"' || replace(" + _SINGULAR + ", chr(1), '%%') || '\";' || chr(10), chr(10) ORDER BY entry_ord)) AS content FROM part_cat GROUP BY language", "part_cat")
def write_strings(spark, sf_dir):
    return _written(spark, sf_dir, "strings")


@query(""" SELECT language || '.xml' AS path, sha256('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<resources>' || chr(10) || string_agg('    <string name="' || id || '"' || CASE status WHEN 'translated' THEN ' translatable="true"' WHEN 'do_not_translate' THEN ' translatable="false"' ELSE '' END
|| '>' || replace(replace(text, '<', '&lt;'), '>', '&gt;') || '</string>' || chr(10), '' ORDER BY entry_ord) || '</resources>' || chr(10)) AS content FROM part_cat WHERE kind = 'singular' GROUP BY language""", "part_cat")
def write_android(spark, sf_dir):
    return _written(spark, sf_dir, "android")


_PATHS = ("a/fr.lproj/Main.strings", "a/pt_BR.lproj/Main.strings", "res/values/x.xml", "res/values-de/x.xml", "res/values-zh-rCN/x.xml", "res/values-b+sr+Latn/x.xml", "l10n/it.csv", "l10n/Main.csv", "en/deep/notes.txt")
_TAGS = ("fr", "pt-BR", "en", "de", "zh-CN", "sr-Latn", "it", None, "en")


@query("SELECT n_nationkey AS k, language, m FROM nation JOIN (SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if t is None else repr(t)})" for k, t in enumerate(_TAGS)) + ") v(place, language)) t ON place = n_nationkey % 9 CROSS JOIN (SELECT 1 AS m) o")
def infer_languages(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("n_nationkey") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), languages.language_from_path(path).alias("language"), F.lit(1).alias("m"))


@query("""SELECT tag, tag NOT IN ('english please', 'x', 'de_') AS valid FROM (SELECT DISTINCT lang AS tag FROM documents WHERE lang IS NOT NULL UNION SELECT unnest(['pt-BR', 'zh_Hans_CN', 'es-419', 'english please', 'x', 'de_'])) t""")
def valid_languages(spark, sf_dir):
    tags = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("tag")).filter("tag is not null")
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("pt-BR", "zh_Hans_CN", "es-419", "english please", "x", "de_")))).alias("tag"))
    return tags.unionByName(more).distinct().select("tag", languages.is_valid(F.col("tag")).alias("valid"))


@query(""" SELECT id, language, text, status FROM part_cat WHERE NOT (language = 'fr' AND id = 'part7Label') AND id <> 'part4Label'
UNION ALL SELECT 'fresh', 'de', 'neu', 'new' UNION ALL SELECT 'fresh', 'it', 'nuovo', 'translated' UNION ALL SELECT 'set', 'fr', 'mis', 'new'""", "part_cat")
def edit_add_remove(spark, sf_dir):
    rows = edit.add(derived(spark, sf_dir, "part_cat"), "de", "fresh", "neu")
    rows = edit.set_value(edit.add(rows, "it", "fresh", "nuovo", status="translated"), "fr", "set", "mis")
    rows = edit.remove(edit.set_value(rows, "fr", "part7Label", ""), None, "part4Label")
    return rows.select("id", "language", "text", "status")


@query(" SELECT id, language, CASE WHEN entry_ord % 3 = 0 THEN 'note on ' || id END AS comment, CASE WHEN entry_ord % 3 = 0 THEN 'true' END AS generated FROM part_cat", "part_cat")
def annotate_catalog(spark, sf_dir):
    rows = derived(spark, sf_dir, "part_cat")
    notes = rows.filter("entry_ord % 3 = 0").select("id", F.concat(F.lit("note on "), "id").alias("comment")).distinct()
    return plan.apply_annotations(rows, notes).select("id", "language", "comment", F.try_element_at("custom", F.lit("is_comment_auto_generated")).alias("generated"))


@query(" SELECT DISTINCT resource_ord, language, 'en' AS source_language, CASE WHEN resource_ord = 1 THEN '2.0' ELSE '1.0' END AS version FROM part_cat", "part_cat")
def fill_metadata(spark, sf_dir):
    own = resources_of(derived(spark, sf_dir, "part_cat"))
    own = own.withColumn("custom", F.when(F.col("resource_ord") == 1, F.create_map(F.lit("version"), F.lit("2.0"))).otherwise(F.col("custom")))
    get = lambda k: F.element_at("custom", F.lit(k)).alias(k)
    return select.fill_metadata(own, "en").select("resource_ord", "language", get("source_language"), get("version"))


@query("""SELECT c_custkey AS k, c_mktsegment AS comment, 'a' || c_custkey || '|b' AS notes, 'a' || c_custkey || chr(10) || chr(10) || 'b' AS joined, 'x - - y' AS xml,
CASE c_custkey % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'do_not_translate' WHEN 2 THEN 'new' END AS status, c_name AS reply, 'tool' AS origin, CASE WHEN c_custkey % 2 = 0 THEN 'a\\tb\\nc' ELSE 'a' || chr(9) || 'b' END AS escaped FROM customer""")
def text_functions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wrapped = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/* "), "c_mktsegment", F.lit(" */"))).otherwise(F.concat(F.lit("// "), "c_mktsegment"))
    notes = texts.notes_of(F.concat(F.lit(" a"), F.col("c_custkey").cast("string"), F.lit(" \n \n\n\n b ")))
    status = F.element_at(F.array(*map(F.lit, (" Needs-Review", "do not translate", "NEW", "no such"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    field = F.concat(F.lit('{"value": "'), F.col("c_name"), F.lit('"}'))
    reply = F.when(F.col("c_custkey") % 2 == 0, field).otherwise(F.concat(F.lit("Here:\n```json\n"), field, F.lit("\n```")))
    custom = texts.with_provenance(F.create_map(F.lit("p.origin"), F.lit("old"), F.lit("p.gone"), F.lit("x")), "p.", {"origin": "tool", "gone": None})
    raw = F.when(F.col("c_custkey") % 2 == 0, F.lit("a\tb\nc")).otherwise(F.lit("a\tb"))
    return rows.select(
        F.col("c_custkey").alias("k"),
        texts.clean_comment(wrapped).alias("comment"),
        F.array_join(notes, "|").alias("notes"),
        texts.comment_of(notes).alias("joined"),
        texts.xml_comment(F.lit("x -- y")).alias("xml"),
        texts.parsed_status(status).alias("status"),
        texts.reply_field(reply, "value").alias("reply"),
        F.array_join(F.map_values(texts.provenance(custom, "p.")), ",").alias("origin"),
        texts.escaped_newlines(raw).alias("escaped"),
    )


@query(""" SELECT (SELECT count(*) FROM docs_cat) AS total_matches, (SELECT string_agg(language, ',' ORDER BY language) FROM (SELECT DISTINCT language FROM docs_cat) l) AS languages,
(SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM docs_cat GROUP BY status) s) AS statuses""", "docs_cat")
def view_summary(spark, sf_dir):
    rows = select.view_summary(derived(spark, sf_dir, "docs_cat"))
    shown = F.array_join(F.transform(F.map_entries("statuses"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return rows.select("total_matches", F.array_join("languages", ",").alias("languages"), shown.alias("statuses"))
