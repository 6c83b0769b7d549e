from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tests.test_export import trips
from velospan.plans import days
from velospan.sources.trips import SOURCE_PART, write_by_source


def written(spark, path, sources):
    """Trips of sources given as {key: [day of January]}."""
    whole = None
    for key, numbers in sources.items():
        at = [datetime(2024, 1, n, 23, 59) for n in numbers]
        rows = trips(spark, [(f"{key}-{i}", start, 120, "1", "3") for i, start in enumerate(at)]).withColumn("source_key", F.lit(key))
        whole = rows if whole is None else whole.unionByName(rows)
    write_by_source(whole, path)


def ids(df):
    return sorted(r.journey_id for r in df.select("journey_id").collect())


def test_days_read_only_the_folders_that_hold_them(spark, tmp_path):
    path = str(tmp_path / "trips")
    written(spark, path, {"a.csv": [1, 2], "b.csv": [3, 9], "c/d.csv": [20, 2]})
    assert ids(days.scan_days(spark, path, date(2024, 1, 2))) == ["a.csv-1", "c/d.csv-1"]  # no ranges yet
    days.refresh_ranges(spark, path)
    for first, last, want in ((2, 2, ["a.csv-1", "c/d.csv-1"]), (3, 8, ["b.csv-0"]), (5, 6, []), (1, 31, None)):
        got = ids(days.scan_days(spark, path, date(2024, 1, first), date(2024, 1, last)))
        assert got == (want if want is not None else ["a.csv-0", "a.csv-1", "b.csv-0", "b.csv-1", "c/d.csv-0", "c/d.csv-1"])
    scan = days.scan_days(spark, path, date(2024, 1, 3))
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PushedFilters: [IsNotNull(start_at), GreaterThanOrEqual(start_at" in plan


def test_ranges_follow_what_changed(spark, tmp_path):
    path = str(tmp_path / "trips")
    written(spark, path, {"a.csv": [1], "b.csv": [3]})
    days.refresh_ranges(spark, path)
    written(spark, path, {"b.csv": [7], "c.csv": [8]})
    changed = spark.createDataFrame([("b.csv",), ("c.csv",), ("gone.csv",)], f"{SOURCE_PART} string")
    days.refresh_ranges(spark, path, changed)
    assert [ids(days.scan_days(spark, path, date(2024, 1, n))) for n in (1, 3, 7, 8)] == [["a.csv-0"], [], ["b.csv-0"], ["c.csv-0"]]
    first = datetime(2024, 1, 1) + timedelta(days=6)
    assert days.scan_days(spark, path, first.date()).first().start_at == datetime(2024, 1, 7, 23, 59)
