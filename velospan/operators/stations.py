"""Station master lookups and the priority match of trip stations to it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velospan.functions.text import digits, has_text, name_key, numeric_key, station_key, text_or_null, words

# Labels of the three matching tiers, in priority order.
BY_NUMBER = "bikepoint_number"
BY_TERMINAL = "terminal_name"
BY_NAME = "common_name"
UNMATCHED = "unmatched"
TOP_UNMATCHED = 25
SEARCH_RESULTS = 8

_MATCHED = ["match_method", "ordinal", "bikepoint_id", "common_name", "terminal_name", "lat", "lon"]


def key_lookup(stations: DataFrame, key: str, columns: Iterable[str] = _MATCHED[1:]) -> DataFrame:
    """One row per key: the first station (by ``ordinal``) that carries it."""
    usable = stations.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    first = F.min_by(F.struct(*columns), F.col("ordinal")).alias("station")
    return usable.groupBy(F.col(key).alias("key")).agg(first).select("key", "station.*")


def id_lookup(stations: DataFrame, columns: Iterable[str] = _MATCHED) -> DataFrame:
    """Numeric keys -> station; a station number wins over a terminal with the same digits."""
    tiers = F.array(
        F.struct(F.col("bikepoint_number_key").alias("key"), F.lit(0).alias("rank"), F.lit(BY_NUMBER).alias("match_method")),
        F.struct(F.col("terminal_name_key").alias("key"), F.lit(1).alias("rank"), F.lit(BY_TERMINAL).alias("match_method")),
    )
    keyed = stations.select("*", F.inline(tiers)).filter(F.col("key").isNotNull() & (F.col("key") != ""))
    first = F.min_by(F.struct(*columns), F.struct("rank", "ordinal")).alias("station")
    return keyed.groupBy("key").agg(first).select("key", "station.*")


def name_lookup(stations: DataFrame, columns: Iterable[str] = _MATCHED) -> DataFrame:
    return key_lookup(stations.withColumn("match_method", F.lit(BY_NAME)), "common_name_key", columns)


def attach_station(
    df: DataFrame,
    stations: DataFrame,
    station_id: str,
    station_name: str,
    prefix: str,
    columns: Iterable[str] = _MATCHED,
    need_name: bool = False,
) -> DataFrame:
    """Add ``<prefix><column>`` of the station that (id, name) matches; null without a match.

    Two equi-joins with the station master's key tables. They carry no hint: the
    planner broadcasts them while the master is under its threshold, so the big
    side is not shuffled, and falls back to a shuffle join beyond it. White space
    around an id or name does not matter to its key. ``need_name`` leaves rows
    without a name unmatched.
    """
    columns = list(columns)
    number, name = digits(station_id), words(station_name)
    if need_name:
        number, name = F.when(has_text(station_name), number), F.when(has_text(station_name), name)
    # Rows without a key match nothing; beyond the broadcast threshold they must not meet in one partition.
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(station_id, station_name), F.lit(4096)).cast("string"))
    number, name = (F.when(F.coalesce(key, F.lit("")) == "", spread).otherwise(key) for key in (number, name))
    tiers = {"_i_": (id_lookup(stations, columns), "_number", number), "_n_": (name_lookup(stations, columns), "_name", name)}
    joined = df.select("*", *[key.alias(label) for _, label, key in tiers.values()])
    for mark, (lookup, label, _) in tiers.items():
        renamed = [F.col(c).alias(f"{mark}{c}") for c in columns]
        joined = joined.join(lookup.select(F.col("key").alias(label), *renamed, F.lit(True).alias(f"{mark}hit")), label, "left")
    found = [
        F.when(F.col("_i_hit"), F.col(f"_i_{c}")).otherwise(F.col(f"_n_{c}")).alias(f"{prefix}{c}") for c in columns
    ]
    return joined.select(*df.columns, *found)


def match_stations(named: DataFrame, stations: DataFrame) -> DataFrame:
    """Match (station_id, station_name) rows to the master, keeping other columns."""
    others = [c for c in named.columns if c not in ("station_id", "station_name")]
    columns = [c for c in _MATCHED if c != "ordinal"]
    matched = attach_station(named, stations, "station_id", "station_name", "matched_", columns)
    station_id, station_name = text_or_null("station_id"), text_or_null("station_name")
    return matched.select(
        *others,
        station_id.alias("station_id"),
        numeric_key("station_id").alias("station_id_key"),
        station_name.alias("station_name"),
        name_key("station_name").alias("station_name_key"),
        F.col("matched_match_method").alias("match_method"),
        *[f"matched_{c}" for c in columns[1:]],
    )


def station_ends(trips: DataFrame, *keep: Column) -> DataFrame:
    """Two rows per trip from one scan: its start station and its end station."""
    ends = F.array(
        *[
            F.struct(
                F.col(f"{side}_station_id").alias("station_id"),
                F.col(f"{side}_station_name").alias("station_name"),
                F.lit(departs).alias("departures"),
                F.lit(1 - departs).alias("arrivals"),
            )
            for side, departs in (("start", 1), ("end", 0))
        ]
    )
    return trips.select(*keep, F.inline(ends))


def station_activity(trips: DataFrame, *keys: Column) -> DataFrame:
    """Departures, arrivals and their sum per station; a round trip counts on both sides."""
    return (
        station_ends(trips, *keys)
        .filter(F.col("station_name").isNotNull())
        .groupBy(*_names(trips, keys), "station_id", "station_name")
        .agg(F.sum("departures").alias("departure_count"), F.sum("arrivals").alias("arrival_count"))
        .withColumn("trip_count", F.col("departure_count") + F.col("arrival_count"))
    )


def _names(trips: DataFrame, keys: Iterable[Column]) -> list[str]:
    return trips.select(*keys).columns if keys else []


def station_matches(trips: DataFrame, stations: DataFrame, *keys: Column) -> DataFrame:
    """Station activity with the matched master row, one row per named station."""
    activity = station_activity(trips, *keys)
    matched = match_stations(activity, stations).filter(F.col("station_name").isNotNull())
    return matched.select(
        *_names(trips, keys),
        station_key("station_id", "station_name").alias("station_key"),
        "station_id",
        "station_name",
        "trip_count",
        "departure_count",
        "arrival_count",
        "match_method",
        F.col("matched_bikepoint_id").alias("bikepoint_id"),
        F.col("matched_lat").alias("lat"),
        F.col("matched_lon").alias("lon"),
    )


def stations_for_day(trips: DataFrame, day: date) -> DataFrame:
    """How often each station was touched by trips starting on ``day``, busiest first."""
    activity = station_activity(trips.filter(starts_on(day)))
    counts = activity.select("station_id", "station_name", "trip_count")
    return counts.orderBy(F.desc("trip_count"), "station_id", "station_name")


def starts_on(day: date) -> Column:
    """Trips starting on ``day``, as a range the Parquet reader can push down."""
    midnight = F.lit(day.isoformat()).cast("timestamp_ntz")
    return (F.col("start_at") >= midnight) & (F.col("start_at") < midnight + F.expr("INTERVAL 1 DAY"))


def sample_station_matches(trips: DataFrame, stations: DataFrame, days: Iterable[date]) -> DataFrame:
    """Match diagnostics for the stations of several dates, in one job."""
    wanted = reduce(or_, [starts_on(day) for day in days], F.lit(False))
    day = F.to_date("start_at").alias("sample_date")
    touched = station_activity(trips.filter(wanted), day).drop("departure_count", "arrival_count")
    return match_stations(touched, stations)


def match_summary(samples: DataFrame) -> DataFrame:
    """Stations per date and match method."""
    labelled = samples.withColumn("match_method", F.coalesce("match_method", F.lit(UNMATCHED)))
    counts = labelled.groupBy("sample_date", "match_method").agg(F.count(F.lit(1)).alias("stations"))
    return counts.orderBy("sample_date", "match_method")


def top_unmatched(samples: DataFrame, limit: int = TOP_UNMATCHED) -> DataFrame:
    """The busiest sampled stations without a match."""
    missing = samples.filter(F.col("match_method").isNull())
    return (
        missing.select("sample_date", "station_id", "station_name", "trip_count")
        .orderBy(F.desc("trip_count"), "sample_date", "station_id", "station_name")
        .limit(limit)
    )


def distinct_stations(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Every station a trip set names, matched; a station without a match keeps its own name."""
    named = station_ends(trips).select("station_id", "station_name").distinct()
    matched = match_stations(named, stations)
    return matched.select(
        station_key("station_id", "station_name").alias("station_key"),
        F.col("matched_bikepoint_id").alias("bikepoint_id"),
        F.when(F.col("match_method").isNull(), F.col("station_name"))
        .otherwise(F.col("matched_common_name"))
        .alias("name"),
        F.col("matched_lat").alias("lat"),
        F.col("matched_lon").alias("lon"),
    ).distinct()


def station_search(stations: DataFrame, text: str, limit: int = SEARCH_RESULTS) -> DataFrame:
    """Stations whose name holds ``text`` in any case, busiest first; blank text finds none."""
    wanted = text.strip().lower()
    found = stations.filter(F.contains(F.lower("station_name"), F.lit(wanted)) if wanted else F.lit(False))
    return found.orderBy(F.desc("trip_count"), "station_key").limit(limit)


def station_records(matches: DataFrame, *keys: str) -> DataFrame:
    """Stations that can be drawn: matched rows with both coordinates."""
    return matches.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        *keys,
        F.col("station_key").alias("id"),
        F.col("station_id").alias("stationId"),
        F.col("station_name").alias("name"),
        F.col("bikepoint_id").alias("bikepointId"),
        F.array("lon", "lat").alias("coord"),
        F.col("trip_count").alias("tripCount"),
        F.col("departure_count").alias("departureCount"),
        F.col("arrival_count").alias("arrivalCount"),
        F.col("match_method").alias("matchMethod"),
    )
