from __future__ import annotations

import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from velospan.operators import replay as P
from velospan.operators import timeline as T

DAY = datetime(2024, 1, 1)


def located(spark, rows):
    """Located trips from (start offset s, end offset s, duration s, has coordinates) rows."""
    schema = "day date, start_at timestamp_ntz, end_at timestamp_ntz, duration_seconds bigint, start_lat double, start_lon double, end_lat double, end_lon double"
    at = lambda s: DAY + timedelta(seconds=s)
    return spark.createDataFrame(
        [(at(s).date(), at(s), at(e), d, 1.0 if ok else None, 1.0, 1.0, 1.0) for s, e, d, ok in rows], schema
    )


def _bins(rows):
    counts = Counter()
    for start, end, duration, ok in rows:
        if ok:
            day, first, last = start // 86400, start % 86400, end % 86400
            if last < first:
                last = min(86399, first + duration)
            for b in range(first // 300, min(287, last // 300) + 1):
                counts[day, b] += 1
    return counts


def test_activity_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(0, 86399, 86399, True), (86399, 86400, 1, True), (86399, 86399 + 86400, 86400, True), (86400 * 3, 86400 * 3, 0, False)]
    for _ in range(300):
        start, duration = rng.randrange(3 * 86400), rng.choice([0, 5, 299, 300, 3000, 90_000, 200_000])
        rows.append((start, start + duration, duration, rng.random() < 0.9))
    got = P.activity_bins(located(spark, rows)).collect()
    days = {date(2024, 1, 1 + n): n for n in range(4)}
    assert len(got) == 4 * 288
    want = _bins(rows)
    assert all(r.active_trips == want[days[r.day], r.time // 300] for r in got)


def test_days_without_trips_are_zero_filled(spark):
    days = P.select_days(located(spark, []), [date(2024, 2, 2), date(2024, 2, 1), date(2024, 2, 1)])
    assert [r.day.day for r in days.collect()] == [1, 2]
    bins = P.activity_bins(located(spark, [(0, 10, 10, True)]), days)
    assert bins.count() == 576 and bins.agg(F.sum("active_trips")).first()[0] == 0


def test_playback_filter_is_a_closed_day(spark):
    schema = ", ".join(f"{c} string" for c in P._PLAYBACK_COLUMNS)
    empty = {c: None for c in P._PLAYBACK_COLUMNS}
    rows = [("a", "2024-01-01 00:00:00", "x"), ("b", "2024-01-01 23:59:59.999999", "x"), ("c", "2024-01-02 00:00:00", "x"), ("d", "2024-01-01 10:00:00", None)]
    trips = spark.createDataFrame(
        [tuple((empty | {"journey_id": j, "start_at": s, "end_station_name": n}).values()) for j, s, n in rows], schema
    ).withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))
    assert sorted(r.journey_id for r in P.playback_trips(trips, date(2024, 1, 1)).collect()) == ["a", "b"]


TRIPS = [
    # id, start, end, route, metres, reversed
    ("a", 100, 200, "r", 1000.0, False),
    ("b", 150, 150, None, None, False),
    ("c", 190, 400, "r", None, True),
    ("d", 90, 90, "r", 500.0, False),
]


def replay(spark):
    schema = "journey_id string, start_second bigint, end_second bigint, route_key string, route_distance_meters double, route_reversed boolean"
    return spark.createDataFrame(TRIPS, schema).select(
        "*",
        F.lit(date(2024, 1, 1)).alias("day"),
        F.lit("shard-0000").alias("route_shard"),
        F.when(F.col("journey_id") == "b", "s2").otherwise("s1").alias("start_station_key"),
        F.lit("s2").alias("end_station_key"),
        F.lit(0.0).alias("start_lon"),
        F.lit(0.0).alias("start_lat"),
        F.lit(0.03).alias("end_lon"),
        F.lit(0.04).alias("end_lat"),
    )


def test_active_trips_include_both_ends(spark):
    got = sorted((r.clock, r.journey_id) for r in T.active_at(replay(spark), [200, 150, 89]).collect())
    assert got == [(150, "a"), (150, "b"), (200, "a"), (200, "c")]
    assert T.active_at(replay(spark), [150], routed_only=True).count() == 1
    with pytest.raises(ValueError):
        T.active_at(replay(spark), [])


def test_running_totals_equal_a_plain_loop(spark):
    clocks = [0, 90, 91, 150, 200, 201, 500]
    for row in T.running_totals(replay(spark), clocks).collect():
        t = row.clock
        begun = [x for x in TRIPS if x[1] <= t]
        metres = sum((x[4] or 0) * min(1, (t - x[1]) / max(1, x[2] - x[1])) for x in begun)
        now = [x for x in begun if x[2] >= t]
        routed = [x for x in begun if x[3]]
        assert (row.journeys, row.routed_journeys, row.unrouted_journeys) == (len(begun), len(routed), len(begun) - len(routed))
        assert math.isclose(row.routed_kilometres, metres / 1000)
        assert (row.active_trips, row.active_routed_trips) == (len(now), len([x for x in now if x[3]]))


def test_balance_at_clocks_and_over_time(spark):
    got = {(r.station_key, r.clock): (r.departures, r.arrivals, r.net) for r in T.station_balance(replay(spark), [50, 150, 999]).collect()}
    assert got == {
        ("s1", 50): (0, 0, 0), ("s2", 50): (0, 0, 0),
        ("s1", 150): (2, 0, -2), ("s2", 150): (1, 2, 1),
        ("s1", 999): (3, 0, -3), ("s2", 999): (1, 4, 3),
    }
    line = [(r.clock, r.net) for r in T.balance_timeline(replay(spark)).filter("station_key = 's2'").orderBy("clock").collect()]
    assert line == [(90, 1), (150, 1), (200, 2), (400, 3)]


def test_drawn_stations_without_events_have_zeros(spark):
    trips = replay(spark)
    day = trips.first().day
    drawn = spark.createDataFrame([(day, "s1"), (day, "idle")], "day date, id string")
    got = {(r.station_key, r.clock): (r.departures, r.arrivals, r.net) for r in T.station_balance(trips, [50, 999], drawn).collect()}
    assert got == {
        ("s1", 50): (0, 0, 0), ("s2", 50): (0, 0, 0), ("idle", 50): (0, 0, 0),
        ("s1", 999): (3, 0, -3), ("s2", 999): (1, 4, 3), ("idle", 999): (0, 0, 0),
    }


def test_recent_events_and_filter(spark):
    got = sorted((r.id, r.age) for r in T.recent_events(replay(spark), [240]).collect())
    assert got == [("a-arrival", 40), ("b-arrival", 90), ("b-departure", 90), ("c-departure", 50)]
    chosen = spark.createDataFrame([("s2", "")], "station_id string, station_name string")
    renamed = replay(spark).withColumn("start_station_key", F.concat("start_station_key", F.lit("\x1f")))
    assert T.station_filter(renamed, chosen).select("journey_id").collect() == [("b",)]


def test_traces_follow_the_route_or_an_arc(spark):
    routes = spark.createDataFrame([("r", [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]])], "route_key string, coordinates array<array<double>>")
    got = {(r.journey_id, r.clock): r for r in T.trip_traces(replay(spark), routes, [150, 295], 0.25).collect()}
    assert got["a", 150].path == [[0.5, 0.0], [1.0, 0.0], [1.0, 0.0]] and got["a", 150].head == [1.0, 0.0]
    assert got["c", 295].path == [[1.5, 0.0], [1.0, 0.0], [1.0, 0.0]]
    assert got["b", 150].path == [[0.0, 0.0]] and not got["b", 150].routed
    alone = T.trip_traces(replay(spark).withColumn("route_key", F.lit(None).cast("string")), routes, [150], 0.0).collect()
    middle = next(r for r in alone if r.journey_id == "a").head
    bend = min(0.012, 0.05 * 0.22)
    assert middle == pytest.approx([0.015 - 0.8 * bend, 0.02 + 0.6 * bend])


def test_activity_domain_and_histogram(spark):
    rows = [(1, 0, 0), (1, 300, 1), (1, 600, 100), (1, 900, 2), (2, 0, 0), (2, 300, 5), (3, 0, 0)]
    bins = spark.createDataFrame(rows, "d int, time int, active_trips bigint").select(
        F.make_date(F.lit(2024), F.lit(1), "d").alias("day"), "time", "active_trips"
    )
    got = {r.day.day: (r.domain_start, r.domain_end) for r in T.activity_domain(bins).collect()}
    assert got == {1: (600, 900), 2: (0, 86399), 3: (0, 86399)}
    days = spark.createDataFrame([(date(2024, 1, 1), 5), (date(2024, 1, 2), 10)], "day date, trips bigint")
    first, second = T.volume_histogram(days).orderBy("day").collect()
    assert (first.share, first.is_monday, first.is_year_start, first.week_label) == (0.5, True, True, "w/c 1 Jan")
    assert (second.share, second.is_month_start, second.weekday) == (1.0, False, "Tuesday")
