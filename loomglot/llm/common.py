"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, pruned to ``doc_id``, ``text`` and the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def tell_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver does, also when the driver found it by ``sys.path`` alone."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns ``doc_id bigint, text string``; a null text counts as empty.

    Everything else is dropped first, so extra or clashing columns of the input cannot collide with
    columns an operator adds.
    """
    tell_workers(df.sparkSession)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def strip_ascii_space(text: Column) -> Column:
    """``text`` without any of the six ASCII white-space characters."""
    for ch in ASCII_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``. Where none is set, a single-machine session (``local[n]``) takes a temporary folder, and a
    cluster is refused: a folder of one machine would be lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A checkpointed table of narrow rows in as few partitions as hold ``rows`` each. One that fits into a single partition is grouped and joined without any
    exchange from here on; the results are the same."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def small_batches(batches, rows: int = 512, byte_budget: int = 8 << 20):
    """Re-slice Arrow batches so that each holds at most ``rows`` rows and about ``byte_budget`` bytes.

    A single row larger than the budget forms its own slice; nothing is dropped.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * byte_budget / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_KEPT: dict = {}


def kept_in_worker(key, make):
    """One object a key for the life of a Python worker, so that the tasks it runs in turn share its memo."""
    if key not in _KEPT:
        forget()  # a worker serves one operator at a time
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what an earlier operator left in this Python worker."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Return freed memory of this Python worker to the system; a worker lives through many tasks and stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: memory goes back when the worker ends


class Memo(dict):
    """A dictionary from bytes to bytes that computes missing values and forgets those not used of late: when its entries take ``limit`` bytes they
    become the old generation, from which a lookup takes them back. So it takes twice the limit at most."""

    #: Bytes of an entry besides its contents: two object headers and its place in the table.
    OVERHEAD = 180

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held, self.old = limit, 0, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.held += len(key) + len(value) + self.OVERHEAD
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = len(key) + len(value) + self.OVERHEAD
        self[key] = value
        return value
