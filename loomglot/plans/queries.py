"""Queries over the derived catalogs, each with the SQL that DuckDB answers the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, languages, placeholders, plurals, texts
from ..operators import checks, diff, edit, merge, normalize, plan, select, sync
from ..schema import STATUSES, as_entries
from .catalogs import derived
from .registry import ORACLE_SQL, QUERIES, query

_STATUS = ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in STATUSES)
_COMPLETION = "CASE WHEN count(*) = sum(CASE WHEN status = 'do_not_translate' THEN 1 ELSE 0 END) THEN 100.0 ELSE round(CAST(sum(CASE WHEN status = 'translated' THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) - sum(CASE WHEN status = 'do_not_translate' THEN 1 ELSE 0 END)) * 100, 2) END AS completion"


@query(f" SELECT resource_ord, language, count(*) AS total, {_STATUS}, 0 AS missing_plural_entries, 0 AS missing_plural_categories, {_COMPLETION} FROM docs_cat GROUP BY resource_ord, language", "docs_cat")
def stats_by_resource(spark, sf_dir):
    return checks.stats(derived(spark, sf_dir, "docs_cat"))


@query(" SELECT count(DISTINCT CASE WHEN language = 'fr' THEN resource_ord END) AS resources, count(DISTINCT id) AS unique_keys FROM part_cat", "part_cat")
def stats_summary(spark, sf_dir):
    return checks.stats_summary(derived(spark, sf_dir, "part_cat"), "fr")


@query(" SELECT id, language, status FROM part_cat WHERE language = 'de'", "part_cat")
def filter_language(spark, sf_dir):
    return select.by_language(derived(spark, sf_dir, "part_cat"), "de").select("id", "language", "status")


@query(" SELECT id, language FROM orders_tgt WHERE language = 'pt-PT'", "orders_tgt")
def filter_language_loose(spark, sf_dir):
    return select.by_language(derived(spark, sf_dir, "orders_tgt"), " PT_br", loose=True).select("id", "language")


@query(" SELECT language, count(*) AS n FROM docs_cat WHERE language IN ('en', 'fr') AND language <> 'fr' GROUP BY language", "docs_cat")
def filter_include_exclude(spark, sf_dir):
    return select.include_exclude(derived(spark, sf_dir, "docs_cat"), "en, fr", "fr").groupBy("language").agg(F.count("*").alias("n"))


@query(" SELECT id, language, status FROM docs_cat WHERE status IN ('needs_review', 'stale')", "docs_cat")
def filter_status(spark, sf_dir):
    return select.by_status(derived(spark, sf_dir, "docs_cat"), "Needs-Review, stale,needs review").select("id", "language", "status")


@query(" SELECT language, status, count(*) AS matches FROM docs_cat GROUP BY language, status", "docs_cat")
def view_status_counts(spark, sf_dir):
    return select.status_counts(derived(spark, sf_dir, "docs_cat"))


@query(" SELECT id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM docs_cat", "docs_cat")
def view_truncated(spark, sf_dir):
    return derived(spark, sf_dir, "docs_cat").select("id", texts.truncated(F.col("text"), 50).alias("shown"))


@query(" SELECT resource_ord, min(entry_ord) AS entry_ord, id FROM line_cat WHERE id = 'part_7' GROUP BY resource_ord, id", "line_cat")
def find_key(spark, sf_dir):
    return select.find(derived(spark, sf_dir, "line_cat"), "part_7").select("resource_ord", "entry_ord", "id")


@query(" SELECT id, language, text FROM part_cat WHERE id IN (SELECT id FROM part_cat WHERE contains(lower(id), 'part12') OR contains(lower(text), 'part12'))", "part_cat")
def search_keys(spark, sf_dir):
    return select.search(derived(spark, sf_dir, "part_cat"), "PART12").select("id", "language", "text")


@query(" SELECT k.id, l.language FROM (SELECT DISTINCT id FROM part_cat) k CROSS JOIN (SELECT DISTINCT language FROM part_cat) l WHERE NOT EXISTS (SELECT 1 FROM part_cat p WHERE p.id = k.id AND p.language = l.language AND p.text <> '')", "part_cat")
def missing_translations(spark, sf_dir):
    return select.missing_translations(derived(spark, sf_dir, "part_cat"))


@query(" SELECT language, count(*) AS entries, count(DISTINCT id) AS keys FROM line_cat GROUP BY language", "line_cat")
def list_languages(spark, sf_dir):
    return select.languages(derived(spark, sf_dir, "line_cat"))


@query(" SELECT DISTINCT id FROM line_cat", "line_cat")
def all_keys(spark, sf_dir):
    return select.all_keys(derived(spark, sf_dir, "line_cat"))


@query(" SELECT n_nationkey AS resource_ord FROM nation WHERE EXISTS (SELECT 1 FROM plural_cat p WHERE p.resource_ord = n_nationkey)", "plural_cat")
def non_empty_resources(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("resource_ord"))
    return select.non_empty_resources(nations, derived(spark, sf_dir, "plural_cat")).select(F.col("resource_ord").cast("int").alias("resource_ord"))


@query(" SELECT resource_ord, count(*) AS n FROM (SELECT resource_ord FROM part_cat UNION ALL SELECT resource_ord + (SELECT max(resource_ord) + 1 FROM part_cat) FROM orders_src) t GROUP BY resource_ord", "part_cat", "orders_src")
def union_all(spark, sf_dir):
    both = select.union_all(derived(spark, sf_dir, "part_cat"), derived(spark, sf_dir, "orders_src"))
    return both.groupBy("resource_ord").agg(F.count("*").alias("n"))


_MERGED = " SELECT language, id, arg_{f}(text, (resource_ord, entry_ord)) AS text, CAST(1 AS BIGINT) AS resource_ord FROM line_cat GROUP BY language, id"


def _merged(spark, sf_dir, strategy):
    return merge.merge(derived(spark, sf_dir, "line_cat"), strategy).select("language", "id", "text", "resource_ord")


@query(_MERGED.format(f="min"), "line_cat")
def merge_first(spark, sf_dir):
    return _merged(spark, sf_dir, "first")


@query(_MERGED.format(f="max"), "line_cat")
def merge_last(spark, sf_dir):
    return _merged(spark, sf_dir, "last")


@query(" SELECT language, id, min(text) AS text, CAST(1 AS BIGINT) AS resource_ord FROM line_cat GROUP BY language, id HAVING count(*) = 1", "line_cat")
def merge_skip(spark, sf_dir):
    return _merged(spark, sf_dir, "skip")


@query(" SELECT language, count(DISTINCT resource_ord) AS resources FROM line_cat GROUP BY language HAVING count(DISTINCT resource_ord) > 1", "line_cat")
def merged_languages(spark, sf_dir):
    return merge.merged_languages(derived(spark, sf_dir, "line_cat"))


_SIDES = """, s AS (SELECT lower(replace(trim(language), '_', '-')) AS language, id, arg_max(kind || ':' || text, (resource_ord, entry_ord)) AS v FROM orders_src GROUP BY 1, 2),
t AS (SELECT lower(replace(trim(language), '_', '-')) AS language, id, arg_max(kind || ':' || text, (resource_ord, entry_ord)) AS v FROM orders_tgt GROUP BY 1, 2),
d AS (SELECT coalesce(s.language, t.language) AS language, coalesce(s.id, t.id) AS id,
  CASE WHEN t.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'removed' WHEN s.v <> t.v THEN 'changed' ELSE 'unchanged' END AS change
  FROM s FULL OUTER JOIN t ON s.language = t.language AND s.id = t.id)"""


@query(_SIDES + " SELECT language, id, change FROM d", "orders_src", "orders_tgt")
def diff_catalogs(spark, sf_dir):
    return diff.diff(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt"))


@query(_SIDES + " SELECT language, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged FROM d GROUP BY language", "orders_src", "orders_tgt")
def diff_summary(spark, sf_dir):
    return diff.summary(diff.diff(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt")))


_SYNC = """, sv AS (SELECT id AS key, lower(replace(trim(language), '_', '-')) AS lang, arg_max(kind, (resource_ord, entry_ord)) AS kind, arg_max(text, (resource_ord, entry_ord)) AS text FROM orders_src GROUP BY 1, 2),
svb AS (SELECT key, split_part(lang, '-', 1) AS base, min(kind) AS kind, min(text) AS text FROM sv GROUP BY 1, 2 HAVING count(*) = 1),
al AS (SELECT alias, candidate, count(*) OVER (PARTITION BY alias) AS n FROM (SELECT DISTINCT text AS alias, id AS candidate FROM orders_src
  WHERE resource_ord = (SELECT min(resource_ord) FROM orders_src WHERE split_part(lower(replace(trim(language), '_', '-')), '-', 1) = 'en') AND kind = 'singular' AND text <> '') q),
tok AS (SELECT id, arg_max(text, entry_ord) AS token FROM orders_tgt
  WHERE resource_ord = (SELECT min(resource_ord) FROM orders_tgt WHERE split_part(lower(replace(trim(language), '_', '-')), '-', 1) = 'en') AND kind = 'singular' AND text <> '' GROUP BY id),
tt AS (SELECT t.*, lower(replace(trim(t.language), '_', '-')) AS lang, split_part(lower(replace(trim(t.language), '_', '-')), '-', 1) AS base, k.key IS NOT NULL AS exact, tok.token
  FROM orders_tgt t LEFT JOIN (SELECT DISTINCT key FROM sv) k ON t.id = k.key LEFT JOIN tok ON t.id = tok.id),
c AS (SELECT resource_ord, entry_ord, lang, base, candidate, 1 AS step FROM tt JOIN al ON tt.id = al.alias WHERE NOT exact
  UNION ALL SELECT resource_ord, entry_ord, lang, base, candidate, 2 FROM tt JOIN al ON tt.token = al.alias WHERE NOT exact),
c2 AS (SELECT c.*, min(step) OVER (PARTITION BY resource_ord, entry_ord) AS least FROM c),
c3 AS (SELECT c2.resource_ord, c2.entry_ord, count(*) AS n, count(*) FILTER (sv.key IS NOT NULL OR svb.key IS NOT NULL) AS n_ok, min(candidate) FILTER (sv.key IS NOT NULL OR svb.key IS NOT NULL) AS ok_id, min(candidate) AS any_id
  FROM c2 LEFT JOIN sv ON sv.key = candidate AND sv.lang = c2.lang LEFT JOIN svb ON svb.key = candidate AND svb.base = c2.base WHERE step = least GROUP BY 1, 2),
r AS (SELECT tt.*, CASE WHEN exact THEN 'exact' WHEN n IS NULL THEN 'none' WHEN n > 1 AND n_ok <> 1 THEN 'ambiguous' ELSE 'fallback' END AS how,
  CASE WHEN exact THEN tt.id WHEN n > 1 AND n_ok <> 1 THEN NULL WHEN n > 1 THEN ok_id ELSE any_id END AS source_id FROM tt LEFT JOIN c3 USING (resource_ord, entry_ord)),
o AS (SELECT r.resource_ord, r.entry_ord, r.id, r.language, how, source_id, coalesce(sv.kind, svb.kind) AS new_kind, coalesce(sv.text, svb.text) AS new_text, r.text, r.kind,
  CASE WHEN how = 'ambiguous' THEN 'ambiguous' WHEN how = 'none' THEN 'unmatched' WHEN coalesce(sv.kind, svb.kind) IS NULL THEN 'missing_language'
    WHEN coalesce(sv.kind, svb.kind) <> r.kind THEN 'type_mismatch' WHEN coalesce(sv.text, svb.text) = r.text THEN 'unchanged' ELSE 'updated' END AS outcome
  FROM r LEFT JOIN sv ON sv.key = source_id AND sv.lang = r.lang LEFT JOIN svb ON svb.key = source_id AND svb.base = r.base)"""


@query(_SYNC + " SELECT resource_ord, entry_ord, id, language, how, source_id, outcome, CASE WHEN outcome = 'updated' THEN new_text ELSE text END AS text FROM o", "orders_src", "orders_tgt")
def sync_catalogs(spark, sf_dir):
    return sync.sync(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt")).select("resource_ord", "entry_ord", "id", "language", "how", "source_id", "outcome", "text")


@query(_SYNC + " SELECT count(*) AS processed, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in sync.OUTCOMES) + ", count(*) FILTER (outcome = 'updated' AND how = 'exact') AS exact_matches, count(*) FILTER (outcome = 'updated' AND how = 'fallback') AS fallback_matches FROM o", "orders_src", "orders_tgt")
def sync_report(spark, sf_dir):
    return sync.report(sync.resolve(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt")))


_NORMALIZED = r"replace(replace(replace(regexp_replace(text, '%([0-9]+)\$@', '%\1$s', 'g'), '%@', '%s'), '%ld', '%d'), '%lu', '%u')"
#: The placeholders that the catalog's texts hold, written out here and not taken from the library.
_PLACEHOLDER = r"%%|%(?:[0-9]+\$)?(?:ld|lu|[@sdu])"
_TOKENS = f"list_filter(regexp_extract_all({{}}, '{_PLACEHOLDER}', 0), lambda t: t <> '%%')"
_SIGNATURE = "array_to_string(list_transform(" + _TOKENS.format(_NORMALIZED) + r", lambda t: coalesce(regexp_extract(t, '^%([0-9]+\$)?', 1), '') || translate(lower(right(t, 1)), '@', 's')), ',')"


@query(f" SELECT id, language, {_NORMALIZED} AS normalized FROM part_cat", "part_cat")
def normalize_placeholders(spark, sf_dir):
    return derived(spark, sf_dir, "part_cat").select("id", "language", placeholders.normalize_placeholders(F.col("text")).alias("normalized"))


@query(f" SELECT id, language, array_to_string({_TOKENS.format('text')}, ',') AS tokens, {_SIGNATURE} AS signature FROM part_cat", "part_cat")
def placeholder_signatures(spark, sf_dir):
    text = F.col("text")
    return derived(spark, sf_dir, "part_cat").select("id", "language", F.array_join(placeholders.tokens(text), ",").alias("tokens"), F.array_join(placeholders.signature(text), ",").alias("signature"))


@query(r" SELECT id, language, replace(regexp_replace(replace(text, '%%', chr(1)), '%([0-9]+\$)?l*s', '%\1@', 'g'), chr(1), '%%') AS apple FROM part_cat", "part_cat")
def apple_placeholders(spark, sf_dir):
    return derived(spark, sf_dir, "part_cat").select("id", "language", placeholders.to_apple(F.col("text")).alias("apple"))


@query(f" SELECT id, count(DISTINCT s) AS signatures, count(DISTINCT language) AS languages FROM (SELECT id, language, CASE WHEN kind = 'singular' THEN {_SIGNATURE} ELSE '' END AS s FROM part_cat) q GROUP BY id HAVING count(DISTINCT s) > 1", "part_cat")
def placeholder_issues(spark, sf_dir):
    return checks.placeholder_issues(derived(spark, sf_dir, "part_cat"))


_PARTED = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(id, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


@query(f" SELECT id, {_PARTED} AS snake, replace({_PARTED}, '_', '-') AS kebab, array_to_string(list_transform(string_split({_PARTED}, '_'), lambda w, k: CASE WHEN k = 1 THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), '') AS camel FROM part_cat WHERE language = 'en'", "part_cat")
def key_styles(spark, sf_dir):
    key = F.col("id")
    return select.by_language(derived(spark, sf_dir, "part_cat"), "en").select("id", keys.snake(key).alias("snake"), keys.kebab(key).alias("kebab"), keys.camel(key).alias("camel"))


#: What the six languages of the catalog require, written out here and not taken from the library.
_REQUIRED = "CASE left(language, 2) WHEN 'en' THEN 'one,other' WHEN 'ru' THEN 'one,few,many,other' WHEN 'ja' THEN 'other' WHEN 'ar' THEN 'zero,one,two,few,many,other' WHEN 'cs' THEN 'one,few,other' WHEN 'lv' THEN 'zero,one,other' END"
_LANG = "split_part(lower(replace(trim(language), '_', '-')), '-', 1)"


@query(f" SELECT DISTINCT language, lower(replace(trim(language), '_', '-')) AS normalized, {_LANG} AS base, {_REQUIRED} AS required FROM plural_cat", "plural_cat")
def language_table(spark, sf_dir):
    lang = F.col("language")
    rows = derived(spark, sf_dir, "plural_cat").select("language", languages.normalized(lang).alias("normalized"), languages.base(lang).alias("base"), F.array_join(plurals.required(lang), ",").alias("required"))
    return rows.distinct()


@query(r" SELECT id, language, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '<[^>]+>', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+', '')), '\n') AS plain FROM part_cat", "part_cat")
def plain_texts(spark, sf_dir):
    return derived(spark, sf_dir, "part_cat").select("id", "language", texts.plain_text(F.col("text")).alias("plain"))


_PLURAL = f", p AS (SELECT *, string_split(categories, ',') AS have, list_filter(string_split({_REQUIRED}, ','), lambda c: NOT list_contains(string_split(categories, ','), c)) AS missing FROM plural_cat)"


@query(_PLURAL + " SELECT resource_ord, entry_ord, language, id, array_to_string(missing, ',') AS missing, array_to_string(list_sort(have), ',') AS have FROM p WHERE len(missing) > 0", "plural_cat")
def plural_issues(spark, sf_dir):
    rows = checks.plural_issues(derived(spark, sf_dir, "plural_cat"))
    return rows.withColumn("missing", F.array_join("missing", ",")).withColumn("have", F.array_join(F.array_sort("have"), ","))


@query(_PLURAL + " SELECT id, language, CASE WHEN status <> 'do_not_translate' AND list_contains(have, 'other') THEN len(missing) ELSE 0 END AS added, CASE WHEN status <> 'do_not_translate' AND list_contains(have, 'other') AND len(missing) > 0 THEN 'needs_review' ELSE status END AS status, CASE WHEN status <> 'do_not_translate' AND list_contains(have, 'other') AND list_contains(missing, 'one') THEN '%d other ' || name WHEN list_contains(have, 'one') THEN '%d one ' || name END AS one FROM p", "plural_cat")
def plural_autofix(spark, sf_dir):
    return checks.autofix_plurals(derived(spark, sf_dir, "plural_cat")).select("id", "language", "added", "status", F.try_element_at("forms", F.lit("one")).alias("one"))


@query(_PLURAL + " SELECT resource_ord, language, count(*) AS total, count(*) FILTER (len(missing) > 0) AS missing_plural_entries, CAST(sum(len(missing)) AS BIGINT) AS missing_plural_categories FROM p GROUP BY resource_ord, language", "plural_cat")
def plural_stats(spark, sf_dir):
    return checks.stats(derived(spark, sf_dir, "plural_cat")).select("resource_ord", "language", "total", "missing_plural_entries", "missing_plural_categories")


@query(" SELECT 'duplicate_language' AS issue, language FROM (SELECT DISTINCT resource_ord, language FROM plural_cat) q GROUP BY language HAVING count(*) > 1", "plural_cat")
def structure_issues(spark, sf_dir):
    rows = derived(spark, sf_dir, "plural_cat")
    return checks.structure_issues(rows.select("resource_ord", "language").distinct(), rows)


@query(f" SELECT resource_ord, row_number() OVER (PARTITION BY resource_ord ORDER BY new_id, entry_ord) - 1 AS entry_ord, new_id AS id, text, (id <> new_id OR old <> text OR row_number() OVER (PARTITION BY resource_ord ORDER BY new_id, entry_ord) <> row_number() OVER (PARTITION BY resource_ord ORDER BY entry_ord)) AS changed FROM (SELECT resource_ord, entry_ord, id, {_PARTED} AS new_id, text AS old, {_NORMALIZED} AS text FROM part_cat) q", "part_cat")
def normalize_catalog(spark, sf_dir):
    return normalize.normalize(derived(spark, sf_dir, "part_cat"), "snake").select("resource_ord", "entry_ord", "id", "text", "changed")


@query(f" SELECT resource_ord, {_PARTED} AS id, count(*) AS entries FROM line_cat GROUP BY 1, 2 HAVING count(*) > 1", "line_cat")
def key_collisions(spark, sf_dir):
    return normalize.collisions(derived(spark, sf_dir, "line_cat"), "snake")


_PLAN = """, s AS (SELECT id, kind, text, status, t.language FROM part_cat CROSS JOIN (SELECT 'fr' AS language UNION ALL SELECT 'de' UNION ALL SELECT 'es') t WHERE part_cat.language = 'en'),
j AS (SELECT s.id, s.language, s.text, CASE WHEN s.status = 'do_not_translate' THEN 'do_not_translate' WHEN s.kind = 'plural' THEN 'plural' WHEN trim(s.text) = '' THEN 'empty_source'
  WHEN p.status = 'do_not_translate' THEN 'target_do_not_translate' WHEN coalesce(p.status, 'new') NOT IN ('new', 'stale') THEN 'status' END AS reason
  FROM s LEFT JOIN part_cat p ON p.id = s.id AND p.language = s.language)"""


def _plan(spark, sf_dir):
    rows = derived(spark, sf_dir, "part_cat")
    return plan.translation_plan(select.by_language(rows, "en"), rows, ["fr", "de", "es"])


@query(_PLAN + " SELECT id, language, reason, text FROM j", "part_cat")
def translation_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("id", "language", "reason", "text")


@query(_PLAN + " SELECT coalesce(reason, 'job') AS reason, count(*) AS n FROM j GROUP BY 1", "part_cat")
def translation_plan_summary(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("job")).alias("reason")).agg(F.count("*").alias("n"))


@query(_PLAN + " SELECT coalesce(p.id, j.id) AS id, coalesce(p.language, j.language) AS language, CASE WHEN j.id IS NOT NULL THEN upper(j.text) ELSE p.text END AS text, CASE WHEN j.id IS NOT NULL THEN 'needs_review' ELSE p.status END AS status FROM part_cat p FULL OUTER JOIN (SELECT * FROM j WHERE reason IS NULL) j ON p.id = j.id AND p.language = j.language", "part_cat")
def apply_translations(spark, sf_dir):
    jobs = _plan(spark, sf_dir)
    results = jobs.filter("reason is null").select("id", "language", F.upper("text").alias("text"))
    return plan.apply_results(derived(spark, sf_dir, "part_cat"), results, jobs).select("id", "language", "text", "status")


_PULL = """, r AS (SELECT language, id, arg_max(kind, (resource_ord, entry_ord)) AS kind, arg_max(text, (resource_ord, entry_ord)) AS text, arg_max(status, (resource_ord, entry_ord)) AS status FROM orders_tgt GROUP BY 1, 2),
m AS (SELECT language, id, arg_min(kind || ':' || text, (resource_ord, entry_ord)) AS v, arg_min(status, (resource_ord, entry_ord)) AS status FROM orders_src GROUP BY 1, 2),
a AS (SELECT r.id, r.language, CASE WHEN r.id NOT IN (SELECT id FROM orders_src) THEN 'unknown' WHEN r.text = '' THEN 'empty' WHEN m.id IS NULL THEN 'insert' WHEN m.v = r.kind || ':' || r.text AND m.status = r.status THEN 'same' ELSE 'update' END AS action, r.text, r.status FROM r LEFT JOIN m USING (language, id))"""


@query(_PULL + " SELECT * FROM a", "orders_src", "orders_tgt")
def pull_catalog(spark, sf_dir):
    return plan.pull(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt")).select("id", "language", "action", "text", "status")


@query(_PULL + """ SELECT s.id, s.language, coalesce(a.text, s.text) AS text, coalesce(a.status, s.status) AS status, a.action FROM orders_src s LEFT JOIN a ON a.id = s.id AND a.language = s.language AND a.action = 'update'
UNION ALL SELECT id, language, text, status, action FROM a WHERE action = 'insert'""", "orders_src", "orders_tgt")
def pull_merged(spark, sf_dir):
    return plan.merge_pulled(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt")).select("id", "language", "text", "status", "action")


@query(_PULL + " SELECT count(*) FILTER (action IN ('insert', 'update')) AS merged, (SELECT count(*) FROM orders_tgt WHERE id NOT IN (SELECT id FROM orders_src)) AS skipped_new_keys FROM a", "orders_src", "orders_tgt")
def pull_report(spark, sf_dir):
    return plan.pull_report(derived(spark, sf_dir, "orders_src"), derived(spark, sf_dir, "orders_tgt"))


@query(""", e AS (SELECT *, CASE WHEN entry_ord % 4 = 0 THEN 'note ' || id END AS comment FROM part_cat)
SELECT id, coalesce(max(CASE WHEN language = 'en' AND trim(text) <> '' THEN text END), id) AS text FROM e GROUP BY id HAVING count(comment) = 0""", "part_cat")
def annotation_targets(spark, sf_dir):
    rows = derived(spark, sf_dir, "part_cat").withColumn("comment", F.when(F.col("entry_ord") % 4 == 0, F.concat(F.lit("note "), "id")))
    return plan.annotation_targets(rows).select("id", "text")


@query(" SELECT 'c' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS id, coalesce(max(CASE WHEN role = 'user' THEN text END), '') AS \"user\", coalesce(max(CASE WHEN role = 'assistant' THEN text END), '') AS assistant FROM conversations GROUP BY conv_id, turn")
def pivot_languages(spark, sf_dir):
    from ..sources.tables import to_wide

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("language"), "text", F.lit(0).alias("resource_ord"), F.monotonically_increasing_id().alias("entry_ord"))
    wide = to_wide(as_entries(rows), ["user", "assistant"])
    return wide.withColumnRenamed("key", "id")


@query(" SELECT p_name AS id, 'brand' AS language, p_brand AS text FROM part UNION ALL SELECT p_name, 'type', p_type FROM part")
def unpivot_languages(spark, sf_dir):
    from ..sources.tables import to_long

    wide = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("key"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return to_long(wide, ["brand", "type"]).select("id", "language", "text")


@query(" SELECT id, language, text, status FROM part_cat WHERE NOT (language = 'fr' AND id = 'part7Label') AND NOT (language = 'de' AND id = 'part2Label') UNION ALL SELECT 'part7Label', 'fr', 'neu', 'translated' UNION ALL SELECT id, 'de', text, 'new' FROM part_cat WHERE language = 'en' AND id = 'part2Label'", "part_cat")
def edit_entries(spark, sf_dir):
    rows = edit.update(derived(spark, sf_dir, "part_cat"), "fr", "part7Label", "neu", "translated")
    return edit.copy(rows, "part2Label", "en", "de", "new").select("id", "language", "text", "status")


@query(" SELECT event_type AS id, count(*) AS n, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS values FROM events GROUP BY event_type")
def event_keys(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "props")
    return events.groupBy(F.col("event_type").alias("id")).agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.k").cast("bigint")).alias("values"))


from . import file_queries  # noqa: E402, F401  (registers the queries over files)
