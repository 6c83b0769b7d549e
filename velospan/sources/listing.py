"""Object-store listing pages (XML) landed as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.functions.text import clean_text

# The element that holds one object and its children.
ROW_TAG = "Contents"
_ELEMENTS = T.StructType([T.StructField(name, T.StringType()) for name in ("Key", "Size", "LastModified", "ETag")])


def read_listing(spark: SparkSession, paths: str | list[str], prefix: str = "", include_empty: bool = False) -> DataFrame:
    """Objects of every landed page: source_key, size_bytes, last_modified, etag, page, position.

    The row of ``prefix`` itself is left out, and so are empty objects unless
    wanted. An object without a key, size or date stops the job.
    """
    pages = spark.read.format("xml").option("rowTag", ROW_TAG).schema(_ELEMENTS)
    found = pages.load(paths if isinstance(paths, str) else ",".join(paths))

    def text(name: str) -> Column:
        return F.btrim(clean_text(name), F.lit('"'))

    def required(name: str) -> Column:
        missing = F.raise_error(F.lit(f"a listed object has no {name}"))
        return F.coalesce(text(name), missing.cast("string"))

    rows = found.select(
        F.col("_metadata.file_path").alias("page"),
        F.monotonically_increasing_id().alias("position"),
        required("Key").alias("source_key"),
        required("Size").cast("bigint").alias("size_bytes"),
        required("LastModified").alias("last_modified"),
        text("ETag").alias("etag"),
    ).filter(F.col("source_key") != prefix)
    return rows if include_empty else rows.filter(F.col("size_bytes") > 0)
