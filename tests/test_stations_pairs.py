from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from velospan.functions.text import name_key, numeric_key
from velospan.operators.pairs import pair_coverage, pending_pairs, pending_summary, rank_pairs
from velospan.operators.running import numbered, with_running_totals
from velospan.operators.stations import (
    distinct_stations,
    match_stations,
    sample_station_matches,
    station_activity,
    station_matches,
    station_search,
    stations_for_day,
    top_unmatched,
)


def master(spark, rows):
    """Stations from (number, terminal, name) rows in master order."""
    schema = "ordinal bigint, bikepoint_number string, terminal_name string, common_name string"
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
    return df.select(
        "*",
        F.concat(F.lit("BikePoints_"), "bikepoint_number").alias("bikepoint_id"),
        numeric_key("bikepoint_number").alias("bikepoint_number_key"),
        numeric_key("terminal_name").alias("terminal_name_key"),
        name_key("common_name").alias("common_name_key"),
        (51.5 + F.col("ordinal") / 10).alias("lat"),
        (F.col("ordinal") / 10).alias("lon"),
    )


STATIONS = [("1", "0100", "River Street , Clerkenwell"), ("100", "7", "High Road"), ("3", "0100", "High road!")]


def trips_of(spark, rows):
    """Trips from (day, start id, start name, end id, end name) rows."""
    schema = "start_at timestamp_ntz, start_station_id string, start_station_name string, end_station_id string, end_station_name string"
    return spark.createDataFrame([(datetime(2024, 1, day), *row) for day, *row in rows], schema)


def test_match_priority_and_first_row_wins(spark):
    named = spark.createDataFrame(
        [
            ("001", "x"),  # number
            ("0100", "x"),  # number 100 before terminal 0100 of station 1
            ("7", "x"),  # terminal only
            (None, "HIGH-ROAD"),  # name: first of two
            ("999", "river street clerkenwell"),  # unknown id, known name
            ("999", "nowhere"),
        ],
        "station_id string, station_name string",
    )
    got = {(r.station_id, r.station_name): (r.match_method, r.matched_bikepoint_id) for r in match_stations(named, master(spark, STATIONS)).collect()}
    assert got == {
        ("001", "x"): ("bikepoint_number", "BikePoints_1"),
        ("0100", "x"): ("bikepoint_number", "BikePoints_100"),
        ("7", "x"): ("terminal_name", "BikePoints_100"),
        (None, "HIGH-ROAD"): ("common_name", "BikePoints_100"),
        ("999", "river street clerkenwell"): ("common_name", "BikePoints_1"),
        ("999", "nowhere"): (None, None),
    }


def test_activity_counts_round_trips_on_both_sides(spark):
    trips = trips_of(spark, [(1, "1", "A", "1", "A"), (1, "1", "A", None, "B"), (2, "2", None, "1", "A")])
    got = sorted(tuple(r) for r in station_activity(trips).fillna("").collect())
    assert got == [("", "B", 0, 1, 1), ("1", "A", 2, 2, 4)]
    assert [r.trip_count for r in stations_for_day(trips, date(2024, 1, 1)).collect()] == [3, 1]


def test_samples_and_unmatched(spark):
    trips = trips_of(spark, [(1, "1", "A", "55", "Gone"), (2, "55", "Gone", "55", "Gone"), (3, "1", "A", "1", "A")])
    samples = sample_station_matches(trips, master(spark, STATIONS), [date(2024, 1, 1), date(2024, 1, 2)])
    assert samples.count() == 3
    assert [(str(r.sample_date), r.trip_count) for r in top_unmatched(samples).collect()] == [("2024-01-02", 2), ("2024-01-01", 1)]


def test_blank_names_stay_unmatched_in_replay_but_not_in_pairs(spark):
    trips = trips_of(spark, [(1, "1", " ", "100", "x")])
    stations = master(spark, STATIONS)
    assert station_matches(trips, stations).select("station_id").collect() == [("100",)]
    assert [r.trips for r in rank_pairs(trips, stations).collect()] == [1]


def test_distinct_stations_keep_their_own_name_without_match(spark):
    trips = trips_of(spark, [(1, "1", "River", "55", "Gone")])
    got = {r.station_key: r.name for r in distinct_stations(trips, master(spark, STATIONS)).collect()}
    assert got == {"1\x1fRiver": "River Street , Clerkenwell", "55\x1fGone": "Gone"}


def test_search_is_case_blind_and_blank_finds_none(spark):
    trips = trips_of(spark, [(1, "1", "High Park", "2", "Low")])
    matches = station_matches(trips, master(spark, STATIONS))
    assert [r.station_name for r in station_search(matches, " hIGH ").collect()] == ["High Park"]
    assert station_search(matches, "  ").count() == 0


def test_pairs_are_undirected_and_oriented(spark):
    trips = trips_of(
        spark,
        [(1, "1", "a", "3", "b"), (1, "3", "b", "1", "a"), (2, "100", "c", "1", "a"), (2, "1", "a", "1", "a"), (2, "1", "a", "77", "zz")],
    )
    ranked = rank_pairs(trips, master(spark, STATIONS))
    rows = [(r.pair_from, r.pair_to, r.trips, r.from_lon, r.to_lon) for r in ranked.collect()]
    assert rows == [("BikePoints_1", "BikePoints_3", 2, 0.0, 0.2), ("BikePoints_1", "BikePoints_100", 1, 0.0, 0.1)]
    assert [r.trips for r in rank_pairs(trips, master(spark, STATIONS), date(2024, 1, 2)).collect()] == [1]

    cached = spark.createDataFrame([("BikePoints_1", "BikePoints_3")], "pair_from string, pair_to string")
    assert pending_pairs(ranked, cached, 1).count() == 0
    assert pending_pairs(ranked, cached, 2).count() == 1
    assert {r.name: r.pairs for r in pending_summary(ranked, cached, 1).collect()} == {"candidate": 1, "cached": 1, "pending": 0}
    shares = [(r["rank"], r.cum_trips, round(r.cum_share, 4)) for r in pair_coverage(ranked).orderBy("rank").collect()]
    assert shares == [(1, 2, 0.6667), (2, 3, 1.0)]


def test_running_totals_equal_a_plain_loop(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 13).alias("v")).repartition(7)
    rows = with_running_totals(df, [F.desc("k")], run=F.col("v")).orderBy("position").collect()
    total = 0
    for place, row in enumerate(rows):
        total += row.v
        assert (row.position, row.k, row.run) == (place, 999 - place, total)
    assert rows[0].run_total == total
    assert numbered(df.limit(0), [F.asc("k")]).count() == 0
