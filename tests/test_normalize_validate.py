from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from velospan.operators.normalize import detect_layout, normalize_trips
from velospan.operators.validate import (
    check_trips,
    rejected_trips,
    rule_counts,
    rule_names,
    split_valid,
    valid_trips,
)
from velospan.schemas import LAYOUTS, TRIP, TRIP_COLUMNS, nullable

BY_NAME = {layout.name: layout for layout in LAYOUTS}


def test_first_fitting_layout_wins_and_extra_columns_are_allowed(spark):
    headers = [layout.required[::-1] + ["Other"] for layout in LAYOUTS] + [["Rental Id"]]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, header array<string>")
    got = [r.l for r in rows.orderBy("i").select(detect_layout(F.col("header")).alias("l")).collect()]
    assert got == [layout.name for layout in LAYOUTS] + [None]


def _normal(spark, layout, **values):
    header = BY_NAME[layout].required
    fields = [values.get(column) for column in BY_NAME[layout].headers]
    schema = "header array<string>, fields array<string>, source_key string, source_etag string, source_member string, source_row_number bigint"
    rows = spark.createDataFrame([(header, fields, "k", "e", None, 1)], schema)
    return normalize_trips(rows).first().asDict()


def test_durations_are_repaired_and_floored(spark):
    times = {"start_at": "01/01/2015 10:00:00", "end_at": "01/01/2015 10:01:30"}
    kept = _normal(spark, "old", duration="120", **times)
    assert (kept["duration_seconds"], kept["duration_ms"]) == (120, 120_000)
    repaired = _normal(spark, "old", duration="12.5", **times)
    assert (repaired["duration_seconds"], repaired["duration_ms"]) == (90, 90_000)
    new = {"start_at": "2023-01-01 10:00", "end_at": "2023-01-01 10:02"}
    assert _normal(spark, "new", duration="61999", **new)["duration_seconds"] == 61
    backwards = _normal(spark, "new", duration="-1500", **new)
    assert (backwards["duration_seconds"], backwards["duration_ms"]) == (-2, -1500)


def test_cleaning_keeps_empty_text_and_missing_columns_are_null(spark):
    row = _normal(spark, "old_missing_end_station_id", journey_id="  ", bike_id=" 7 ", end_station_name="X")
    assert row["journey_id"] == "" and row["bike_id"] == "7"
    assert row["end_station_id"] is None and row["bike_model"] is None and row["start_at"] is None


START = datetime(2024, 5, 1, 8, 0)


def _trip(**changes):
    trip = {
        "journey_id": "j",
        "bike_id": "b",
        "bike_model": None,
        "start_at": START,
        "end_at": START + timedelta(seconds=600),
        "start_station_id": "1",
        "start_station_name": "A",
        "end_station_id": None,
        "end_station_name": "B",
        "duration_seconds": 600,
        "duration_ms": 600_500,
        "source_key": "f.csv",
        "source_etag": "e",
        "source_member": None,
        "source_row_number": 1,
    } | changes
    return tuple(trip[c] for c in TRIP_COLUMNS)


def _failed(spark, *trips):
    rows = spark.createDataFrame(list(trips), nullable(TRIP))
    return sorted((r.journey_id or "", sorted(r.failed_rules)) for r in check_trips(rows).collect())


def test_each_rule_rejects_its_own_fault(spark):
    cases = {
        "ok": ({}, []),
        "no bike": ({"bike_id": None}, ["bike_id|nullability"]),
        "empty name": ({"end_station_name": ""}, ["end_station_name|min_length"]),
        "empty model": ({"bike_model": ""}, ["bike_model|min_length"]),
        "row zero": ({"source_row_number": 0}, ["source_row_number|min"]),
        "units": ({"duration_ms": 601_000}, ["duration_units_agree"]),
        "clock": ({"duration_seconds": 720, "duration_ms": 720_001}, ["duration_matches_timestamps"]),
        "clock edge": ({"duration_seconds": 720, "duration_ms": 720_000}, []),
        "two weeks": (
            {"end_at": START + timedelta(days=14), "duration_seconds": 1_209_600, "duration_ms": 1_209_600_000},
            [],
        ),
        "too long": (
            {"end_at": START + timedelta(days=14), "duration_seconds": 1_209_600, "duration_ms": 1_209_600_001},
            ["plausible_duration"],
        ),
        "negative": (
            {"duration_seconds": -1, "duration_ms": -1000},
            ["duration_ms|min", "duration_seconds|min", "duration_matches_timestamps"],
        ),
    }
    got = dict(_failed(spark, *[_trip(journey_id=name, **change) for name, (change, _) in cases.items()]))
    want = {name: sorted(rules) for name, (_, rules) in cases.items()}
    assert got == want


def test_every_copy_of_a_key_is_rejected_within_its_source_only(spark):
    trips = [_trip(), _trip(source_row_number=2), _trip(source_key="g.csv"), _trip(journey_id=None), _trip(journey_id=None)]
    got = _failed(spark, *trips)
    assert got == [
        ("", ["journey_id|nullability", "primary_key"]),
        ("", ["journey_id|nullability", "primary_key"]),
        ("j", []),
        ("j", ["primary_key"]),
        ("j", ["primary_key"]),
    ]


def test_split_counts_and_statuses(spark):
    rows = spark.createDataFrame([_trip(), _trip(journey_id="k", bike_id=None)], nullable(TRIP))
    valid, rejected = split_valid(rows)
    assert [r.journey_id for r in valid.collect()] == ["j"] and valid.columns == TRIP_COLUMNS
    row = rejected.first().asDict()
    statuses = {name: row[name] for name in rule_names()}
    assert statuses.pop("bike_id|nullability") == "invalid" and set(statuses.values()) == {"valid"}
    assert [tuple(r) for r in rule_counts(check_trips(rows)).collect()] == [("bike_id|nullability", 1)]


def test_values_that_do_not_cast_fail_their_row(spark):
    rows = spark.createDataFrame([_trip(), _trip(journey_id="k")], nullable(TRIP))
    text = F.when(F.col("journey_id") == "k", "many").otherwise(F.col("duration_ms").cast("string"))
    checked = check_trips(rows.withColumn("duration_ms", text).drop("source_member"))
    failed = {r.journey_id: r.failed_rules for r in checked.collect()}
    assert failed == {"j": [], "k": ["duration_ms|dtype", "duration_ms|nullability"]}
    assert valid_trips(checked).count() == 1 and rejected_trips(checked).count() == 1
    # The rejects have a column for the cast, also when what was checked has been written and read again.
    for rejects in (rejected_trips(checked), split_valid(rows.withColumn("duration_ms", text))[1]):
        row = rejects.first().asDict()
        assert row["duration_ms|dtype"] == row["duration_ms|nullability"] == "invalid" and row["primary_key"] == "valid"
        assert [c for c in rejects.columns if c.endswith("|dtype")] == ["duration_ms|dtype"]


def test_a_key_with_many_copies_is_not_gathered(spark):
    rows = spark.range(3000).select(
        *[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(TRIP, _trip())]
    ).withColumn("source_row_number", F.monotonically_increasing_id() + 1)
    mixed = rows.withColumn(
        "journey_id", F.when(F.col("source_row_number") % 3 == 0, "hot").otherwise(F.expr("uuid()"))
    )
    mixed = spark.createDataFrame(mixed.collect(), nullable(TRIP))
    checked = check_trips(mixed)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
    hot = checked.filter("journey_id = 'hot'")
    assert hot.count() > 900 and hot.filter(F.array_contains("failed_rules", "primary_key")).count() == hot.count()
    assert checked.filter("journey_id <> 'hot'").filter(F.size("failed_rules") > 0).count() == 0
