"""SQL over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velospan.schemas import TRIP
from velospan.sources.files import has_files
from velospan.sources.trips import scan_with_defaults

# View names and the folders they read.
TRIP_VIEWS = {"trips": "validated/trips_by_file", "normalized_trips": "cache/normalized"}
TABLE_VIEWS = {
    "bikepoints": "reference/bikepoints/bikepoints.parquet",
    "station_match_samples": "reference/bikepoints/station_match_samples.parquet",
    "google_routes": "reference/routes/google_bicycle/routes.parquet",
    "mapbox_routes": "reference/routes/mapbox_cycling/routes.parquet",
    "route_pair_coverage": "reference/routes/pair_coverage_cdf.parquet",
}


def register_views(spark: SparkSession, root: str) -> list[str]:
    """Register a temporary view for every table that exists below ``root``; none is an error."""
    registered = []
    for name, path in (TRIP_VIEWS | TABLE_VIEWS).items():
        if has_files(spark, f"{root}/{path}"):
            table = scan_with_defaults(spark, f"{root}/{path}", TRIP) if name in TRIP_VIEWS else spark.read.parquet(f"{root}/{path}")
            table.createOrReplaceTempView(name)
            registered.append(name)
    if not registered:
        raise FileNotFoundError(f"{root} holds no table to query")
    return registered


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """Run one statement; trailing semicolons are dropped."""
    return spark.sql(query.strip().rstrip(";"))
