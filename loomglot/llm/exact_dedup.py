"""Exact de-duplication by content-defined chunk recipes, in DataFrame operations only.

Texts are compared without ASCII white space. Each normalised text is cut at content-defined places (the first
sentence-like end after a minimum length, at a maximum length at the latest), so that a shared passage mostly yields the
same chunks wherever it stands. Chunks are de-duplicated into a dictionary keyed by a 128-bit hash; the dictionary is
verified against the chunk texts themselves: where two different chunks share a hash, each gets its own ordinal. A text is then
its recipe, the ordered list of verified identifiers, and only recipes are grouped and joined; long texts move once,
as distinct chunks, to be verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_text, documents, strip_ascii_space

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks_of(normalised: Column) -> Column:
    """Content-defined chunks; concatenated in order they are the text. An empty text has none."""
    return F.regexp_extract_all(normalised, F.lit(rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?|;]|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit("recipe"), chunk).alias("b"))


def colliding_chunks(texts: DataFrame) -> DataFrame:
    """``h, chunk, ordinal`` for hashes that stand for more than one chunk text (none are expected).

    Copies of a chunk collapse before the shuffle, so a passage in a third of all rows costs one row a task.
    """
    pieces = texts.select(F.explode("chunks").alias("chunk")).distinct()
    by_hash = pieces.groupBy(chunk_hash(F.col("chunk")).alias("h")).agg(F.count("*").alias("n"), F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return by_hash.filter("n > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code points in
    its original text stays, then the smallest id. A null text counts as empty, empty texts equal one another, a null id
    sorts before every other; rows repeated with the same id are one document id, so every copy of the staying row is marked kept.
    An empty table gives no rows; other columns are ignored.
    """
    rows = doc_text(df, id_col, text_col)
    norm = strip_ascii_space(F.col("text"))
    texts = rows.select("doc_id", F.char_length("text").alias("n_chars"), norm.alias("norm")).withColumn("chunks", chunks_of(F.col("norm")))
    pieces = F.transform("chunks", chunk_hash)
    ambiguous = colliding_chunks(texts).select("h").take(1)  # the dictionary, verified against the texts
    if ambiguous:
        # Two different chunks share 128 bits: identifiers take the chunk itself along, which tells them apart.
        pieces = F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("recipe"), c).alias("b"), c.alias("text")))
    recipes = texts.select("doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), pieces.alias("recipe"))
    groups = recipes.groupBy("recipe").agg(F.min(F.struct((-F.col("n_chars")).alias("fewest"), "doc_id")).alias("best"), F.count("*").alias("size")).filter("size > 1")
    # Groups are written, so that the join has an exchange of its own on either side and a group of very many copies can be split among tasks.
    groups = checkpointed(groups.select(F.col("recipe").alias("its"), F.col("best.doc_id").alias("best_id"), "size"))
    joined = recipes.join(groups, F.col("recipe") == F.col("its"), "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
