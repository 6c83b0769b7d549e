"""The route job: which pairs still need a route, and recording landed responses."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from velospan.operators.pairs import pair_coverage, pending_pairs, rank_pairs
from velospan.plans.catalog import TABLE_VIEWS, TRIP_VIEWS
from velospan.plans.days import scan_days
from velospan.sources.files import has_files
from velospan.sources.route_cache import append_routes, parse_route_responses, read_route_lines, route_cache_snapshot
from velospan.sources.trips import scan_trips

# Candidate pairs per provider and the folders of the caches.
PAIR_LIMITS = {"google": 10_000, "mapbox": 100_000}
LINES = {
    "google": "reference/routes/google_bicycle/routes.jsonl",
    "mapbox": "reference/routes/mapbox_cycling/routes.jsonl",
}


def _tables(spark: SparkSession, root: str, day: date | None = None) -> tuple[DataFrame, DataFrame]:
    path = f"{root}/{TRIP_VIEWS['trips']}"
    trips = scan_trips(spark, path) if day is None else scan_days(spark, path, day)
    return trips, spark.read.parquet(f"{root}/{TABLE_VIEWS['bikepoints']}")


def pending(
    spark: SparkSession, root: str, provider: str, day: date | None = None, limit: int | None = None
) -> DataFrame:
    """The busiest pairs of validated trips that the provider's cache does not hold yet."""
    trips, stations = _tables(spark, root, day)
    ranked = rank_pairs(trips, stations, day)
    lines, schema = f"{root}/{LINES[provider]}", "pair_from string, pair_to string"
    cached = spark.read.schema(schema).json(lines) if has_files(spark, lines) else spark.createDataFrame([], schema)
    return pending_pairs(ranked, cached, PAIR_LIMITS[provider] if limit is None else limit)


def record(spark: SparkSession, root: str, provider: str, responses: DataFrame) -> DataFrame:
    """Append landed responses to the provider's cache and renew its snapshot; returns the snapshot."""
    append_routes(parse_route_responses(responses, provider), f"{root}/{LINES[provider]}")
    path = f"{root}/{TABLE_VIEWS[provider + '_routes']}"
    route_cache_snapshot(read_route_lines(spark, f"{root}/{LINES[provider]}")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Write the coverage table of all ranked pairs; returns it."""
    path = f"{root}/{TABLE_VIEWS['route_pair_coverage']}"
    pair_coverage(rank_pairs(*_tables(spark, root))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
