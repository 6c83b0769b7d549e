"""Tables that are replaced whole: each version in a folder of its own, and a pointer to the current one."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the pointer, a table with one row per version written.
CURRENT = "current"


def write_version(table: DataFrame, root: str) -> str:
    """Write a new version below ``root`` and make it current; returns its folder.

    The pointer's last row names the current version, so a reader sees either the old
    version or the complete new one.
    """
    version = f"version-{uuid4().hex}"
    table.write.parquet(f"{root}/{version}")
    pointer = table.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    pointer.write.mode("append").parquet(f"{root}/{CURRENT}")
    return f"{root}/{version}"


def read_version(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current version of the table below ``root``."""
    latest = spark.read.parquet(f"{root}/{CURRENT}").agg(F.max_by("version", "at")).first()[0]
    return spark.read.schema(schema).parquet(f"{root}/{latest}")
