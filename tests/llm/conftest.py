import sys
from pathlib import Path

import pytest
from helpers import DATA

sys.path.insert(0, str(Path(__file__).resolve().parent))
from edge_rows import CLASHING, ROWS  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Rows of every awkward kind, with columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "en", f"src{k % 2}" if k != 3 else None) for k, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string")
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"), *(F.lit("clash").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
