"""Origin-destination pairs: ranking, pending work and coverage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velospan.operators.running import with_running_totals
from velospan.operators.stations import attach_station, starts_on


def _ranking() -> list[Column]:
    return [F.desc("trips"), F.asc("pair_from"), F.asc("pair_to")]


def _pair_counts(trips: DataFrame, stations: DataFrame, day: date | None) -> DataFrame:
    if day is not None:
        trips = trips.filter(starts_on(day))
    ends = trips.select("start_station_id", "start_station_name", "end_station_id", "end_station_name")
    for side in ("start", "end"):
        ends = attach_station(
            ends, stations, f"{side}_station_id", f"{side}_station_name", f"{side}_", ["ordinal"]
        )
    # The count runs on two numbers per trip; names and coordinates join later.
    counts = (
        ends.select(F.col("start_ordinal").alias("origin"), F.col("end_ordinal").alias("goal"))
        .filter(F.col("origin").isNotNull() & F.col("goal").isNotNull())
        .groupBy("origin", "goal")
        .agg(F.count(F.lit(1)).alias("trips"))
    )
    details = F.struct("ordinal", F.col("common_name").alias("name"), "lat", "lon")
    for side in ("origin", "goal"):
        known = stations.select(
            F.col("ordinal").alias(side), F.col("bikepoint_id").alias(f"{side}_id"), details.alias(f"{side}_at")
        )
        counts = counts.join(known, side)
    forward = F.col("origin_id") < F.col("goal_id")
    oriented = counts.filter(F.col("origin_id") != F.col("goal_id")).select(
        F.least("origin_id", "goal_id").alias("pair_from"),
        F.greatest("origin_id", "goal_id").alias("pair_to"),
        F.when(forward, F.col("origin_at")).otherwise(F.col("goal_at")).alias("near"),
        F.when(forward, F.col("goal_at")).otherwise(F.col("origin_at")).alias("far"),
        "trips",
    )
    merged = oriented.groupBy("pair_from", "pair_to").agg(
        F.sum("trips").alias("trips"), F.min(F.struct("near", "far")).alias("ends")
    )
    return merged.select(
        "pair_from",
        "pair_to",
        "trips",
        *[
            F.col(f"ends.{end}.{field}").alias(f"{side}_{field}")
            for side, end in (("from", "near"), ("to", "far"))
            for field in ("name", "lat", "lon")
        ],
    )


def rank_pairs(trips: DataFrame, stations: DataFrame, day: date | None = None) -> DataFrame:
    """Undirected pairs of different matched stations by trips, busiest first."""
    return _pair_counts(trips, stations, day).orderBy(*_ranking())


def candidate_pairs(ranked: DataFrame, limit: int) -> DataFrame:
    return ranked.orderBy(*_ranking()).limit(limit)


def pending_pairs(ranked: DataFrame, cached: DataFrame, limit: int) -> DataFrame:
    """The top ``limit`` pairs that no cached route covers; the limit comes first."""
    fetched = cached.select("pair_from", "pair_to").distinct()
    return candidate_pairs(ranked, limit).join(fetched, ["pair_from", "pair_to"], "left_anti").orderBy(*_ranking())


def pending_summary(ranked: DataFrame, cached: DataFrame, limit: int) -> DataFrame:
    """Candidate, cached and pending pair counts, one row per name."""
    fetched = cached.select("pair_from", "pair_to").distinct()
    parts = {
        "candidate": candidate_pairs(ranked, limit),
        "cached": fetched,
        "pending": pending_pairs(ranked, cached, limit),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("pairs")).select(F.lit(n).alias("name"), "pairs") for n, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def pair_coverage(ranked: DataFrame) -> DataFrame:
    """Rank, trips, cumulative trips and cumulative share of all trips per pair."""
    pairs = ranked.select("pair_from", "pair_to", "trips")
    summed = with_running_totals(pairs, _ranking(), cum_trips=F.col("trips"))
    return summed.select(
        (F.col("position") + 1).alias("rank"),
        "pair_from",
        "pair_to",
        "trips",
        "cum_trips",
        (F.col("cum_trips") / F.col("cum_trips_total")).alias("cum_share"),
    )
