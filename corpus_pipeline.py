"""From raw documents to packed token windows, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``. A stage works on
every row that the one before kept. Null and empty texts pass every stage (they are scored by their statistics and pack as an end token alone), null ids
and repeated rows are treated as each operator's docstring says, and empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomglot.llm import jaccard_join, line_dedup, packing, pii, quality
from loomglot.llm.common import checkpointed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learn from the labels of these documents, drop those it rejects.

    Null and empty texts are scored by their statistics; null ids have no label; repeated rows stay or go together; without labels nothing is dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.score(docs.select(*COLUMNS), quality.fit(docs, labels)).filter("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that too many documents of one source hold go from all of them; the documents stay.

    Null texts stay null; null sources form one host; every row, repeated or not, is a page of its source.
    """
    return _documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of documents that links of 0.8 on five-word shingles join, the one with the smallest id stays.

    Documents without words link with none and stay; rows repeated under one id stay or go together.
    """
    found = jaccard_join.jaccard_components(docs, words=5, numerator=80, denominator=100)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind in brackets; null texts stay null, and every row stays."""
    return _documents(pii.redact(docs.select(*COLUMNS)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of documents in windows of 2048 tokens, with their token ids. Null and empty texts are an end token alone, null ids stand first,
    repeated rows are documents of their own."""
    return packing.pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack_windows),
]

#: Four of the stages run models or iterate, which SQL doesn't express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage but the last returns is computed once, into the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
