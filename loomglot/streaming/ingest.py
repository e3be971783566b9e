"""Catalog files as a stream: an addition, for folders that files keep arriving in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTRIES
from ..sources.files import parse_file
from ..operators.select import latest


def entry_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Entries of files as they arrive; ``resource_ord`` is the file's modification time, so later files are later resources."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def rows(batches):
        for batch in batches:
            out = []
            for path, at, content in zip(batch["path"], batch["at"], batch["content"]):
                for r in parse_file(re.sub(r"^file:/+", "/", path), bytes(content)):
                    out += [(at, n, r.language, r.domain, e.id, e.kind, e.text, e.plural_id, e.forms, e.comment, e.status, e.custom) for n, e in enumerate(r.entries)]
            yield pd.DataFrame(out, columns=ENTRIES.names)

    return files.select("path", F.unix_micros("modificationTime").alias("at"), "content").mapInPandas(rows, ENTRIES)


def _runs(spark: SparkSession, table: str) -> dict[tuple[int, int], str]:
    """The finished runs of a table: first and last batch, and folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(folder)]  # as many as the logarithm of the batches, twice at most
    found = {m: f"{table}/{n}" for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)", n))}
    return {(int(m[1]), int(m[2])): f for m, f in found.items() if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))}


def _live(runs: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """Runs that no wider run covers."""
    return {k: f for k, f in runs.items() if not any(o != k and o[0] <= k[0] and k[1] <= o[1] for o in runs)}


def merged_table(spark: SparkSession, table: str) -> DataFrame:
    """The last entry of each language and key in a table that ``keep_merged`` keeps."""
    live = _live(_runs(spark, table))
    rows = spark.read.schema(ENTRIES).parquet(*live.values()) if live else spark.createDataFrame([], ENTRIES)
    return latest(rows, "language", "id")


def keep_merged(stream: DataFrame, table: str, checkpoint: str):
    """Keep a Parquet table of the last entry of each language and key, as runs of batches: as in a binary counter, batch n is merged with the runs behind it whose
    batches its lowest bits count, so a row is written again as often as the logarithm of the number of batches, and not with every batch. A run
    that is done is not written again, so a batch that runs twice gives the same table; runs that a wider one covers are removed after it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, n = batch.sparkSession, number + 1
        first, runs = n - (n & -n) + 1, _runs(batch.sparkSession, table)
        if (first, n) not in runs:
            behind = [f for (a, b), f in _live(runs).items() if a >= first and b < n]
            rows = batch.unionByName(spark.read.schema(ENTRIES).parquet(*behind)) if behind else batch
            latest(rows, "language", "id").write.mode("overwrite").parquet(f"{table}/run-{first}-{n}")
        done = _runs(spark, table)
        for k, f in done.items():
            if k not in _live(done):
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
