from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from velospan.operators.routes import load_routes
from velospan.plans import catalog, routes
from velospan.schemas import TRIP, TRIP_COLUMNS, nullable
from velospan.sources.trips import write_by_source
from tests.test_stations_pairs import STATIONS, master


def test_pending_pairs_shrink_as_responses_land(spark, tmp_path):
    root, at = str(tmp_path), datetime(2024, 1, 1, 8)
    ends = [("1", "3"), ("3", "1"), ("100", "1")]
    base = {c: None for c in TRIP_COLUMNS} | {"start_at": at, "end_at": at, "source_key": "f.csv", "source_row_number": 1}
    rows = [base | {"journey_id": str(i), "start_station_id": a, "end_station_id": b} for i, (a, b) in enumerate(ends)]
    trips = spark.createDataFrame([tuple(r[c] for c in TRIP_COLUMNS) for r in rows], nullable(TRIP))
    write_by_source(trips, f"{root}/{catalog.TRIP_VIEWS['trips']}")
    master(spark, STATIONS).write.parquet(f"{root}/{catalog.TABLE_VIEWS['bikepoints']}")

    first = routes.pending(spark, root, "mapbox")
    assert [(r.pair_to, r.trips) for r in first.collect()] == [("BikePoints_3", 2), ("BikePoints_100", 1)]
    assert routes.pending(spark, root, "mapbox", date(2024, 1, 2)).count() == 0
    reply = '{"code":"Ok","routes":[{"distance":5,"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}'
    landed = first.limit(1).select(
        "*",
        F.lit(reply).alias("response"),
        F.lit(None).cast("string").alias("failure_type"),
        F.lit(None).cast("string").alias("failure_message"),
    )
    snapshot = routes.record(spark, root, "mapbox", landed)
    assert [(r.route_key, r.distance_meters) for r in load_routes(snapshot).collect()] == [("BikePoints_1|BikePoints_3", 5.0)]
    assert [r.pair_to for r in routes.pending(spark, root, "mapbox").collect()] == ["BikePoints_100"]
    assert routes.pending(spark, root, "mapbox", limit=1).count() == 0
    assert routes.pending(spark, root, "google", limit=1).count() == 1

    routes.write_coverage(spark, root)
    assert catalog.register_views(spark, root) == ["trips", "bikepoints", "mapbox_routes", "route_pair_coverage"]
    assert catalog.run_sql(spark, "SELECT max(cum_trips) AS n FROM route_pair_coverage").first().n == 3
