"""Trips of some days without opening the files of others.

Trips lie in one folder per source. A small table beside them holds the first and last
day of each source; a scan of days is joined with it on the folder column, and Spark
prunes folders by the sources that are left before it lists or opens a file of theirs.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.plans.versions import CURRENT, read_version, write_version
from velospan.schemas import TRIP, nullable
from velospan.sources.files import has_files
from velospan.sources.trips import SOURCE_PART, scan_trips
from velospan.staging import staged

#: What a folder of trips has the ranges of its sources under.
RANGES = "_day_ranges"
_RANGE = T.StructType().add(SOURCE_PART, T.StringType()).add("first_day", T.DateType()).add("last_day", T.DateType())


def _folders(spark: SparkSession, path: str) -> DataFrame:
    """Trips with the folder each lies in."""
    schema = T.StructType([*nullable(TRIP).fields, T.StructField(SOURCE_PART, T.StringType())])
    return spark.read.schema(schema).parquet(path)


def _ranges(trips: DataFrame) -> DataFrame:
    day = F.to_date("start_at")
    return trips.groupBy(SOURCE_PART).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def refresh_ranges(spark: SparkSession, path: str, changed: DataFrame | None = None) -> None:
    """Bring the ranges of a folder of trips up to date.

    ``changed`` names the folders (``source_part``) that were written or removed since;
    only those are read. Without it, or without ranges so far, all are.
    """
    known = has_ranges(spark, path)
    if not has_files(spark, path):
        fresh = spark.createDataFrame([], _RANGE)
    elif changed is None or not known:
        fresh = _ranges(_folders(spark, path))
    else:
        fresh = _ranges(_folders(spark, path).join(changed, SOURCE_PART, "left_semi"))
    if known and changed is not None:
        kept = read_version(spark, f"{path}{RANGES}", _RANGE).join(changed, SOURCE_PART, "left_anti")
        fresh = kept.unionByName(fresh)
    write_version(staged(fresh, "day-ranges"), f"{path}{RANGES}")


def has_ranges(spark: SparkSession, path: str) -> bool:
    return has_files(spark, f"{path}{RANGES}/{CURRENT}")


def scan_days(spark: SparkSession, path: str, first: date, last: date | None = None) -> DataFrame:
    """Trips that start from ``first`` to ``last`` (or on ``first``), of the sources whose range meets those days.

    A folder without ranges is read whole and filtered.
    """
    last = first if last is None else last
    begin, end = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (first, last + timedelta(days=1)))
    if not has_ranges(spark, path):
        trips = scan_trips(spark, path)
    else:
        ranges = read_version(spark, f"{path}{RANGES}", _RANGE)
        wanted = ranges.filter((F.col("first_day") <= F.lit(last)) & (F.col("last_day") >= F.lit(first)))
        trips = _folders(spark, path).join(wanted.select(SOURCE_PART), SOURCE_PART, "left_semi").drop(SOURCE_PART)
    return trips.filter((F.col("start_at") >= begin) & (F.col("start_at") < end))
