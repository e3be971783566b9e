"""Site-relative line de-duplication.

For each host, a line's ratio is the number of the host's pages that contain it over all pages of the host. Lines whose ratio
exceeds the limit are boilerplate of that host and are dropped from its pages. The ratio alone decides about every repeated line; a line of one page is not
repeated, however small its host is (``LEAST_PAGES`` = 2).

Pages are counted by a 64-bit hash of the line first, which never counts too few; the lines found are then counted again by their texts, so that a
hash that two lines share drops neither.

A host has fewer than ``lines per page / ratio`` boilerplate lines, so they fit into one array per host. Their number and size are
checked: a small list is broadcast and texts do not move; beyond that the texts are joined with it by (host, salt), so a host
with a third of all pages spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

RATIO, LEAST_PAGES = 0.02, 2
BROADCAST_LINES, BROADCAST_BYTES, SALTS = 20_000, 16 << 20, 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blank(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r\x0b\x0c"))) == 0


def small(found: DataFrame, column: str, most: int) -> bool:
    """Whether a list of lines (or hashes) may be broadcast, by its number and bytes."""
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0)).alias("bytes")).first()
    return size["n"] <= most and size["bytes"] <= BROADCAST_BYTES


def with_list(rows: DataFrame, found: DataFrame, column: str, broadcast_lines: int) -> DataFrame:
    """``rows`` (with ``__key``, the host, and ``__own``, what their salt is made of) and the host's list ``__lines``, null if it has none."""
    per_host = found.groupBy("host").agg(F.collect_list(column).alias("__lines")).withColumnRenamed("host", "__host")
    if small(found, column, broadcast_lines):
        return rows.join(F.broadcast(per_host), F.col("__key") == F.col("__host"), "left")
    salted = per_host.withColumn("__its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__own"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col("__key") == F.col("__host")) & (F.col("__salt") == F.col("__its_salt")), "left")


def boilerplate(rows: DataFrame, ratio: float, least_pages: int, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``host, line`` of lines in more than ``ratio`` of the pages of ``host`` and on at least ``least_pages``."""
    lines = F.filter(lines_of(F.col("text")), lambda x: ~blank(x))
    pages = checkpointed(rows.groupBy("host").agg(F.count("*").alias("pages")))

    def often(counts):
        counts = counts.filter(F.col("n") >= least_pages)
        return counts.join(pages, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))

    hashes = rows.select("host", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("line"))
    found = checkpointed(often(hashes.groupBy("host", "line").agg(F.count("*").alias("n"))).select("host", "line"))
    own = with_list(rows.select(F.col("host").alias("__key"), F.col("text").alias("__own")), found, "line", broadcast_lines).filter(F.col("__lines").isNotNull())
    own = own.select("__key", "__lines", F.array_distinct(F.filter(lines_of(F.col("__own")), lambda x: ~blank(x))).alias("its"))
    own = own.withColumn("hits", F.array_intersect(F.transform("its", lambda x: F.xxhash64(x)), "__lines")).filter(F.size("hits") > 0)
    texts = own.select(F.col("__key").alias("host"), F.explode(F.filter("its", lambda x: F.array_contains(F.col("hits"), F.xxhash64(x)))).alias("line"))
    return often(texts.groupBy("host", "line").agg(F.count("*").alias("n"))).select("host", "line")


def drop_boilerplate(df: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``df`` with the boilerplate lines of its host taken out of ``text_col``, and the counts ``lines_before`` and ``lines_dropped``.

    A line goes if more than ``ratio`` of its host's pages and at least ``least_pages`` of them have it; at the ratio itself it stays. Lines end at
    ``\\n`` and are compared as they are; blank lines are never dropped. Every row is a page, repeated rows and
    empty texts too; null hosts form one host; a null text counts as empty (no line) and stays null. A very long text is one row of work for a task.
    Columns of ``df`` that are named like the two counts are replaced. An empty table gives no rows.
    """
    names = [c for c in df.columns if c not in ("lines_before", "lines_dropped")]
    keys = df.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = checkpointed(boilerplate(keys, ratio, least_pages, broadcast_lines))
    rows = df.select(*names).withColumn("__key", F.coalesce(F.col(host_col).cast("string"), F.lit(""))).withColumn("__own", F.col(text_col))
    joined = with_list(rows, found, "line", broadcast_lines)
    before = lines_of(F.col(text_col))
    joined = joined.withColumn("__before", before).withColumn("__hits", F.array_intersect("__before", "__lines"))  # in time of both together
    kept = F.filter(F.col("__before"), lambda x: ~F.array_contains(F.col("__hits"), x))
    joined = joined.withColumn("__kept", F.when(F.size("__hits") > 0, kept).otherwise(F.col("__before")))
    n_lines = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", F.lit(0)).otherwise(F.size("__before"))
    return joined.select(
        *(F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in names),
        n_lines.cast("bigint").alias("lines_before"),
        F.coalesce(F.size("__before") - F.size("__kept"), F.lit(0)).cast("bigint").alias("lines_dropped"),
    )


def op8_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = drop_boilerplate(docs)
    return out.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT host, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''))) AS line FROM d
), c AS (
  SELECT host, line, count(*) AS n FROM l GROUP BY host, line HAVING count(*) >= {LEAST_PAGES}
), p AS (
  SELECT host, count(*) AS pages FROM d GROUP BY host
), b AS (
  SELECT c.host, list(line) AS lines FROM c JOIN p USING (host) WHERE n > CAST({RATIO} AS DOUBLE) * pages GROUP BY c.host
), k AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS before, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(b.lines, []), x)) AS kept
  FROM d LEFT JOIN b ON d.host = b.host
)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(before) END AS n_lines, len(before) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM k
"""
