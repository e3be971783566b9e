"""Catalogs derived from the benchmark tables, as SQL that both Spark and DuckDB run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_entries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

SQL = {
    # A document is an entry of its language; its source is the resource, its label the status.
    "docs_cat": """
SELECT CAST(substr(d.source, 4) AS BIGINT) AS resource_ord, d.doc_id AS entry_ord, d.lang AS language, d.source AS domain,
  'doc_' || CAST(d.doc_id AS STRING) AS id, CASE WHEN d.text = '' THEN 'empty' ELSE 'singular' END AS kind, d.text AS text,
  CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.toxic = 1 THEN 'stale' WHEN l.quality = 1 THEN 'translated' ELSE 'needs_review' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # A part in three languages, with texts that hold placeholders.
    "part_cat": """
SELECT CAST(n.ord AS BIGINT) AS resource_ord, p.p_partkey AS entry_ord, n.language AS language, p.p_brand AS domain,
  'part' || CAST(p.p_partkey AS STRING) || 'Label' AS id,
  CASE WHEN p.p_partkey % 5 = 3 THEN 'empty' ELSE 'singular' END AS kind,
  CASE p.p_partkey % 5
    WHEN 0 THEN 'Hello %1$@ ' || p.p_name || CASE WHEN n.ord = 1 AND p.p_partkey % 7 = 0 THEN ' %s' ELSE ' %ld' END
    WHEN 1 THEN 'Sold 50%% of ' || p.p_name || CASE WHEN n.ord = 2 THEN ' to %@' ELSE ' to %s' END
    WHEN 2 THEN '  ' || p.p_brand || ' <b>' || p.p_name || '</b> %lu %@ '
    WHEN 3 THEN ''
    ELSE p.p_type || ' %d' END AS text,
  CASE WHEN p.p_partkey % 5 = 3 THEN 'new' WHEN p.p_partkey % 11 = 0 THEN 'do_not_translate' WHEN p.p_partkey % 13 = n.ord THEN 'stale' ELSE 'translated' END AS status
FROM part p CROSS JOIN (SELECT 0 AS ord, 'en' AS language UNION ALL SELECT 1, 'fr' UNION ALL SELECT 2, 'de') n
WHERE n.ord = 0 OR p.p_partkey % (n.ord + 2) <> 0""",
    "orders_src": """
SELECT CAST(o_custkey % 3 AS BIGINT) AS resource_ord, o_orderkey AS entry_ord,
  CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'pt_BR' END AS language, '' AS domain,
  'order_' || CAST(o_orderkey AS STRING) AS id, 'singular' AS kind, o_orderpriority || ' ' || CAST(o_orderkey % 50 AS STRING) AS text, 'translated' AS status
FROM orders""",
    # Some keys gone, some texts changed, some keys named by a source text, some unknown.
    "orders_tgt": """
SELECT CAST(o_custkey % 3 AS BIGINT) AS resource_ord, o_orderkey AS entry_ord,
  CASE o_custkey % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'fr' ELSE 'pt-PT' END AS language, '' AS domain,
  CASE WHEN o_orderkey % 10 = 8 THEN o_orderpriority || ' ' || CAST(o_orderkey % 50 AS STRING) WHEN o_orderkey % 10 = 9 THEN 'shifted_' || CAST(o_orderkey AS STRING) ELSE 'order_' || CAST(o_orderkey AS STRING) END AS id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'empty' ELSE 'singular' END AS kind,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN o_orderpriority || ' changed' ELSE o_orderpriority || ' ' || CAST(o_orderkey % 50 AS STRING) END AS text,
  CASE WHEN o_orderkey % 5 = 1 THEN 'new' ELSE 'translated' END AS status
FROM orders WHERE o_orderkey % 7 <> 0""",
    "line_cat": """
SELECT CAST(l_linenumber AS BIGINT) AS resource_ord, l_orderkey AS entry_ord, l_returnflag AS language, l_linestatus AS domain,
  'part_' || CAST(l_partkey AS STRING) AS id, 'singular' AS kind, 'qty ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' of ' || CAST(l_orderkey AS STRING) AS text, 'translated' AS status
FROM lineitem""",
    "plural_cat": """
SELECT CAST(c.c_nationkey AS BIGINT) AS resource_ord, c.c_custkey AS entry_ord,
  CASE c.c_nationkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' WHEN 2 THEN 'ja' WHEN 3 THEN 'ar-EG' WHEN 4 THEN 'cs' ELSE 'lv_LV' END AS language,
  '' AS domain, 'customer_' || CAST(c.c_custkey AS STRING) AS id, 'plural' AS kind,
  CASE c.c_custkey % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'one,other' WHEN 2 THEN 'one,few,many,other' WHEN 3 THEN 'few' WHEN 4 THEN 'zero,one,two,few,many,other' ELSE 'one,few,other' END AS categories,
  c.c_name AS name, CASE WHEN c.c_custkey % 9 = 0 THEN 'do_not_translate' ELSE 'translated' END AS status
FROM customer c""",
}


def oracle(name: str) -> str:
    """A derived catalog as a common table expression."""
    return f"{name} AS ({SQL[name]})"


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived catalog as entries (with ``categories`` turned into forms where the catalog has plurals)."""
    text = SQL[name]
    used = [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    df = spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
    if "categories" in df.columns:
        categories = F.split("categories", ",")
        df = df.withColumn("forms", F.map_from_arrays(categories, F.transform(categories, lambda c: F.concat(F.lit("%d "), c, F.lit(" "), F.col("name")))))
    return as_entries(df)
