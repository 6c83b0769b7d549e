"""Parquet trip tables: scans with a fixed schema, and the per-source sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.schemas import TRIP, nullable
from velospan.sources.files import has_files

SOURCE_PART = "source_part"


def source_part(source_key: Column | str) -> Column:
    """A source key as a folder name."""
    return F.replace(source_key, F.lit("/"), F.lit("__"))


def scan_with_defaults(spark: SparkSession, path: str | list[str], schema: T.StructType = TRIP) -> DataFrame:
    """Parquet files read as ``schema``: columns a file lacks are null, others are ignored."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(nullable(schema)).option("recursiveFileLookup", "true").parquet(*paths)


def scan_trips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All validated trips below a folder; a folder without Parquet files is an error."""
    paths = [path] if isinstance(path, str) else list(path)
    if not any(has_files(spark, p) for p in paths):
        raise FileNotFoundError(f"{path} holds no trips")
    return scan_with_defaults(spark, paths)


def write_by_source(df: DataFrame, path: str, *extra_partitions: str) -> None:
    """Write ``df`` with one folder per source file; sources in ``df`` replace what they had.

    The rebalance hint gathers a source's rows for its folder and splits sources
    that are much larger than the others over several tasks and files.
    """
    parted = df.withColumn(SOURCE_PART, source_part("source_key"))
    keys = [*extra_partitions, SOURCE_PART]
    balanced = parted.hint("rebalance", *[F.col(key) for key in keys])
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
