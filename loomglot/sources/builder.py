"""Building a catalog from several inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import validate
from ..schema import ENTRIES, RESOURCES, as_entries
from .files import PER_FILE, expand, read_catalog

#: Resources of one input are numbered within this step.
PER_INPUT = PER_FILE << 20


class CatalogBuilder:
    """Collects inputs in order; later inputs have higher resource numbers."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts = spark, []

    def add_file(self, path: str, format: str | None = None, language: str | None = None) -> "CatalogBuilder":
        return self.add_files([path], format, language)

    def add_files(self, patterns: list[str], format: str | None = None, language: str | None = None) -> "CatalogBuilder":
        """Files by path or pattern."""
        self.parts.append(read_catalog(self.spark, expand(patterns), format, language))
        return self

    def add_frames(self, resources: DataFrame, entries: DataFrame) -> "CatalogBuilder":
        self.parts.append((resources.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in RESOURCES)), as_entries(entries)))
        return self

    def build(self, check: bool = False) -> tuple[DataFrame, DataFrame]:
        """``resources, entries``; with ``check``, structural faults raise."""
        if not self.parts:
            self.parts.append((self.spark.createDataFrame([], RESOURCES), self.spark.createDataFrame([], ENTRIES)))
        based = [tuple(df.withColumn("resource_ord", F.col("resource_ord") + F.lit(k * PER_INPUT)) for df in part) for k, part in enumerate(self.parts)]
        resources, entries = (reduce(lambda a, b: a.unionByName(b), (part[n] for part in based)) for n in (0, 1))
        if check:
            validate(resources, entries)
        return resources, entries
