"""Per-day replay tables: matched trips, routed trip records, activity, summaries."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.functions.clock import BIN_SECONDS, DAY_SECONDS, LAST_SECOND, playback_end, second_of_day
from velospan.functions.text import station_key
from velospan.operators.stations import attach_station, starts_on, station_matches

_PLAYBACK_COLUMNS = [
    "journey_id",
    "bike_id",
    "bike_model",
    "start_at",
    "end_at",
    "start_station_id",
    "start_station_name",
    "end_station_id",
    "end_station_name",
    "duration_seconds",
]
_COORDINATES = ["start_lat", "start_lon", "end_lat", "end_lon"]


def date_range(trips: DataFrame) -> DataFrame:
    """First and last start date as ISO text, and the number of trips."""
    day = F.to_date("start_at")
    return trips.agg(
        F.min(day).cast("string").alias("min_date"),
        F.max(day).cast("string").alias("max_date"),
        F.count(F.lit(1)).alias("trip_count"),
    )


def select_days(trips: DataFrame, dates: Iterable[date] = (), limit: int | None = None) -> DataFrame:
    """Days to export: the given ones without repeats, else every start date; ascending."""
    wanted = sorted(set(dates))
    if wanted:
        days = trips.sparkSession.createDataFrame([(day,) for day in wanted], "day date")
    else:
        days = trips.select(F.to_date("start_at").alias("day")).distinct()
    days = days.orderBy("day")
    return days if limit is None else days.limit(limit)


def playback_trips(trips: DataFrame, day: date | None = None) -> DataFrame:
    """Trips with an end station name, with their ``day``; of one day when it is given."""
    if day is not None:
        trips = trips.filter(starts_on(day))
    named = trips.filter(F.col("end_station_name").isNotNull())
    return named.select(F.to_date("start_at").alias("day"), *_PLAYBACK_COLUMNS)


def locate_trips(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Add the matched station of both ends: id, coordinates and match method."""
    for side in ("start", "end"):
        wanted = ["bikepoint_id", "lat", "lon", "match_method"]
        trips = attach_station(
            trips, stations, f"{side}_station_id", f"{side}_station_name", f"{side}_", wanted, need_name=True
        )
    return trips


def has_coordinates() -> Column:
    """All four coordinates are known."""
    return reduce(and_, [F.col(name).isNotNull() for name in _COORDINATES])


def matched_trips(located: DataFrame) -> DataFrame:
    return located.filter(has_coordinates())


def replay_trips(routed: DataFrame) -> DataFrame:
    """Matched, routed trips in clock seconds: the table behind trip records and clock queries."""
    start, end, duration = F.col("start_at"), F.col("end_at"), F.col("duration_seconds")
    return matched_trips(routed).select(
        "day",
        "journey_id",
        "bike_id",
        "bike_model",
        "start_at",
        second_of_day(start).cast("bigint").alias("start_second"),
        playback_end(start, end, duration).alias("end_second"),
        "duration_seconds",
        *[f"{side}_station_{part}" for side in ("start", "end") for part in ("id", "name")],
        station_key("start_station_id", "start_station_name").alias("start_station_key"),
        station_key("end_station_id", "end_station_name").alias("end_station_key"),
        *_COORDINATES,
        "route_key",
        "route_shard",
        "route_distance_meters",
        "route_reversed",
    )


def trip_records(replay: DataFrame, *keep: str) -> DataFrame:
    """The compact 16-field record of a trip as it is exported."""
    return replay.select(*keep, *_record_fields())


def trip_record() -> Column:
    return F.struct(*_record_fields())


def path_trip_records(replay: DataFrame, *keep: str) -> DataFrame:
    """The record with its path inline in place of the route fields; ``replay`` comes
    from ``routes.with_route_path``, whose path runs from trip start to trip end."""
    return replay.select(*keep, *_trip_fields(), F.col("route_path").alias("path"))


def _trip_fields() -> list[Column]:
    return [
        F.col("journey_id").alias("id"),
        F.col("bike_id").alias("bikeId"),
        F.col("bike_model").alias("bikeModel"),
        F.col("start_second").alias("start"),
        F.col("end_second").alias("end"),
        F.col("duration_seconds").alias("durationSeconds"),
        F.col("start_station_id").alias("fromStationId"),
        F.col("start_station_name").alias("fromStationName"),
        F.col("end_station_id").alias("toStationId"),
        F.col("end_station_name").alias("toStationName"),
        F.array("start_lon", "start_lat").alias("fromCoord"),
        F.array("end_lon", "end_lat").alias("toCoord"),
    ]


def _record_fields() -> list[Column]:
    return [
        *_trip_fields(),
        F.col("route_key").alias("routeKey"),
        F.col("route_shard").alias("routeShard"),
        F.col("route_distance_meters").alias("routeDistanceMeters"),
        F.col("route_reversed").alias("routeReversed"),
    ]


def activity_bins(located: DataFrame, days: DataFrame | None = None, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Active matched trips in every bin of every day, zero-filled.

    A trip adds one where it starts and takes one away after its last bin, so it
    costs two rows whatever its length; the running sum then has one row per bin.
    Days without a matched trip (and days of ``days`` without any) stay at zero.
    """
    start, end = second_of_day(F.col("start_at")), second_of_day(F.col("end_at"))
    wrapped = F.least(F.lit(LAST_SECOND), start + F.col("duration_seconds"))
    last = F.when(end < start, wrapped).otherwise(end)
    bins = -(-DAY_SECONDS // bin_seconds)

    timed = located.select(
        "day",
        F.floor(start / bin_seconds).cast("int").alias("first"),
        F.floor(last / bin_seconds).cast("int").alias("last"),
        has_coordinates().alias("matched"),
    )
    counts = F.coalesce(F.col("matched") & (F.col("first") <= F.col("last")), F.lit(False))
    timed = timed.withColumn("change", counts.cast("int"))
    steps = F.array(
        F.struct(F.col("first").alias("bin"), F.col("change").alias("change")),
        F.struct((F.col("last") + 1).alias("bin"), (-F.col("change")).alias("change")),
    )
    changes = (
        timed.select("day", F.inline(steps)).groupBy("day", "bin").agg(F.sum("change").alias("change"))
    )
    # One short map per day (a bin at most once), so that days and changes come from one pass.
    by_day = changes.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("bin", "change"))).alias("changes"))
    if days is not None:
        by_day = days.select("day").distinct().join(by_day, "day", "left")
    grid = by_day.select("day", "changes", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    running = W.partitionBy("day").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    change = F.coalesce(F.try_element_at("changes", "bin"), F.lit(0))
    return grid.select("day", (F.col("bin") * bin_seconds).alias("time"), F.sum(change).over(running).alias("active_trips"))


def day_summary(
    routed: DataFrame, trips: DataFrame, stations: DataFrame, days: DataFrame | None = None, matches: DataFrame | None = None
) -> DataFrame:
    """Trip, station and routed counts of every day; zeros for days of ``days`` without trips.

    ``routed`` holds all playback trips located and joined to routes, ``trips``
    the playback trips alone (for the station count). ``matches`` are their
    ``station_matches`` by day, where these are known already.
    """
    matched = has_coordinates()
    counts = routed.groupBy("day").agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.count_if(matched).alias("matched_trips"),
        F.count_if(~matched).alias("unmatched_trips"),
        F.count_if(matched & F.col("route_key").isNotNull()).alias("routed_trips"),
    )
    if matches is None:
        matches = station_matches(trips, stations, F.col("day"))
    placed = matches.filter(F.col("lat").isNotNull())
    drawn = placed.groupBy("day").agg(F.count(F.lit(1)).alias("station_count"))
    summary = counts.join(drawn, "day", "left")
    if days is not None:
        summary = days.select("day").distinct().join(summary, "day", "left")
    names = ["total_trips", "matched_trips", "unmatched_trips", "station_count", "routed_trips"]
    return summary.select("day", *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in names])
