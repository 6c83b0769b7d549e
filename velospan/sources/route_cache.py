"""Route caches: append-only JSON lines, their Parquet snapshot, landed API responses."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.operators.running import numbered
from velospan.schemas import ROUTE_CACHE, nullable

JSON_COLUMNS = ["from_coord", "to_coord", "geometry", "error"]
# Fixed value: the code of a route whose request failed.
FETCH_ERROR = "FetchError"
BATCH, PLACE = "cache_batch", "cache_place"


def read_route_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cached routes with ``ordinal``, their order in the cache: by batch, then by place in the batch.

    Lines that were not appended here carry neither and come first, older files before
    newer ones. Nested values are kept as JSON text. Blank lines are skipped.
    """
    schema = nullable(ROUTE_CACHE).add(BATCH, T.LongType()).add(PLACE, T.LongType())
    rows = spark.read.schema(schema).json(path).select(
        *ROUTE_CACHE.fieldNames(),
        F.col(BATCH).alias("_batch"),
        F.col(PLACE).alias("_place"),
        F.col("_metadata.file_modification_time").alias("_written"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    # Files of one append end in any order: their times order only what has no batch.
    foreign = [F.when(F.col("_batch").isNull(), F.col(name)) for name in ("_written", "_file", "_start")]
    order = [F.asc_nulls_first("_batch"), F.asc("_place"), *[F.asc(c) for c in foreign], F.asc("_seq")]
    return numbered(rows, order).drop("_batch", "_place", "_written", "_file", "_start", "_seq")


def route_cache_snapshot(lines: DataFrame) -> DataFrame:
    """The Parquet form of the cache: JSON columns as text, with ``null`` for a missing value."""
    texts = {name: F.coalesce(name, F.lit("null")) for name in JSON_COLUMNS}
    return lines.withColumns(texts)


def append_routes(routes: DataFrame, path: str) -> None:
    """Append route rows (see ``parse_route_responses``) to the cache, in the order of ``routes``.

    Every row is stamped with its batch (the time of the append) and its place in it.
    """
    nested = {
        "from_coord": "array<double>",
        "to_coord": "array<double>",
        "geometry": "struct<type: string, coordinates: array<array<double>>>",
        "error": "map<string, string>",
    }
    parsed = {name: F.from_json(F.nullif(name, F.lit("null")), kind) for name, kind in nested.items()}
    stamped = routes.withColumns(parsed).withColumns({BATCH: F.lit(time.time_ns()), PLACE: F.monotonically_increasing_id()})
    stamped.write.mode("append").json(path)


# Where each provider's response keeps the route's fields.
PROVIDERS = {
    "mapbox": {
        "response": "code string, uuid string, error string, routes array<struct<distance: double, "
        "duration: double, weight: double, weight_name: string, geometry: string>>",
        "distance_meters": "route.distance",
        "duration_seconds": "route.duration",
        "weight": "route.weight",
        "weight_name": "route.weight_name",
        "geometry": "route.geometry",
        "code": "reply.code",
        "uuid": "reply.uuid",
    },
    "google": {
        "response": "error string, routes array<struct<distanceMeters: double, duration: string, "
        "staticDuration: string, polyline: struct<geoJsonLinestring: string>>>",
        "distance_meters": "route.distanceMeters",
        "duration": "route.duration",
        "static_duration": "route.staticDuration",
        "geometry": "route.polyline.geoJsonLinestring",
    },
}


def parse_route_responses(responses: DataFrame, provider: str) -> DataFrame:
    """Landed responses -> route cache rows.

    ``responses`` has the pair columns of ``pairs.rank_pairs`` with ``response``,
    and ``failure_type`` / ``failure_message`` for requests that gave none; those
    become rows with an error and no metrics.
    """
    places = PROVIDERS[provider]
    replied = responses.withColumn("reply", F.from_json("response", places["response"]))
    first = replied.withColumn("route", F.get("reply.routes", 0))
    failed = F.col("failure_type").isNotNull()

    def metric(name: str) -> Column:
        kind = ROUTE_CACHE[name].dataType
        value = F.col(places[name]) if name in places else F.lit(None)
        return F.when(~failed, value.cast(kind)).alias(name)

    def coordinate(side: str) -> Column:
        return F.to_json(F.array(f"{side}_lon", f"{side}_lat")).alias(f"{side}_coord")

    geometry = F.col(places["geometry"])
    if provider == "mapbox":
        points = F.from_json(geometry, "coordinates array<array<double>>")["coordinates"]
        geometry = F.when(F.size(points) > 0, geometry)
    failure = F.to_json(F.struct(F.col("failure_type").alias("type"), F.col("failure_message").alias("message")))
    code = F.col(places["code"]) if "code" in places else F.lit(None)
    return first.select(
        "pair_from",
        "pair_to",
        "from_name",
        "to_name",
        coordinate("from"),
        coordinate("to"),
        F.col("trips").alias("trip_count"),
        metric("distance_meters"),
        metric("duration"),
        metric("duration_seconds"),
        metric("static_duration"),
        metric("weight"),
        metric("weight_name"),
        F.when(~failed, geometry).alias("geometry"),
        F.when(failed, F.lit(FETCH_ERROR)).otherwise(code.cast("string")).alias("code"),
        metric("uuid"),
        F.when(failed, failure).otherwise(F.col("reply.error")).alias("error"),
    )
