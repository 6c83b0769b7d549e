from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from velospan.operators import routes as R


def cache(spark, rows):
    """Cache rows from (pair_from, pair_to, geometry, error, trips, metres)."""
    schema = "ordinal bigint, pair_from string, pair_to string, geometry string, error string, trip_count bigint, distance_meters double"
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


LINE = '{"type":"LineString","coordinates":[[0,1],[2,3.5]]}'


def test_only_usable_routes_load(spark):
    rows = [
        ("a", "b", LINE, "null", None, 5.0),
        ("a", "c", LINE, None, 3, None),
        ("a", "d", LINE, '{"status":404}', 3, 5.0),
        ("a", "e", "null", "null", 3, 5.0),
        ("a", "f", None, "null", 3, 5.0),
        ("a", "g", '{"coordinates":[]}', "null", 3, 5.0),
        ("a", "h", '{"type":"LineString"}', "null", 3, 5.0),
    ]
    got = R.load_routes(cache(spark, rows)).orderBy("ordinal").collect()
    assert [(r.route_key, r.trip_count) for r in got] == [("a|b", 0), ("a|c", 3)]
    assert got[0].coordinates == [[0.0, 1.0], [2.0, 3.5]]


def test_later_provider_overrides_but_keeps_place(spark):
    first = R.load_routes(cache(spark, [("a", "b", LINE, None, 1, 1.0), ("a", "c", LINE, None, 1, 2.0), ("a", "b", LINE, None, 1, 3.0)]))
    second = R.load_routes(cache(spark, [("a", "d", LINE, None, 1, 4.0), ("a", "c", LINE, None, 1, 5.0)]))
    merged = R.merge_providers(first, second).orderBy("place").collect()
    assert [(r.route_key, r.distance_meters) for r in merged] == [("a|b", 3.0), ("a|c", 5.0), ("a|d", 4.0)]
    single = R.single_provider(first)
    assert single.count() == 3
    assert {r.route_key: r.distance_meters for r in R.route_lookup(single).collect()} == {"a|b": 3.0, "a|c": 2.0}


def test_route_join_and_path(spark):
    routes = R.merge_providers(R.load_routes(cache(spark, [("A_10", "A_9", LINE, None, 1, 7.0)])))
    trips = spark.createDataFrame(
        [("1", "A_10", "A_9"), ("2", "A_9", "A_10"), ("3", "A_9", "A_9"), ("4", None, "A_9"), ("5", "A_1", "A_9"), ("6", "", "A_9")],
        "journey_id string, start_bikepoint_id string, end_bikepoint_id string",
    )
    joined = R.route_join(trips, R.route_lookup(routes))
    got = {r.journey_id: (r.route_key, r.route_reversed, r.route_distance_meters) for r in joined.collect()}
    assert got["1"] == ("A_10|A_9", False, 7.0) and got["2"] == ("A_10|A_9", True, 7.0)
    assert all(got[j] == (None, False, None) for j in "3456")
    paths = {r.journey_id: r.route_path for r in R.with_route_path(joined, routes).collect()}
    assert paths["2"] == [[2.0, 3.5], [0.0, 1.0]] and paths["1"] == paths["2"][::-1] and paths["3"] is None


def _greedy(sizes, target):
    shards, held, number = [], 0, 0
    for size in sizes:
        if held and held + size > target:
            number, held = number + 1, 0
        held += size
        shards.append(number)
    return shards


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("span_targets,fan", [(1, 2), (1, 64), (2, 3), (256, 64)])
def test_packing_equals_the_greedy_loop(spark, monkeypatch, seed, span_targets, fan):
    monkeypatch.setattr(R, "_SPAN_TARGETS", span_targets)
    monkeypatch.setattr(R, "_FAN", fan)
    rng = random.Random(seed)
    points = [rng.choice([1, 2, 3, 5, 40 if seed % 2 else 4]) for _ in range(120)]
    rows = [(i * 3, f"r{i}", [[0.5, 1.5]] * n) for i, n in enumerate(points)]
    routes = spark.createDataFrame(rows, "place bigint, route_key string, coordinates array<array<double>>")
    packed = R.pack_shards(routes, 100, 1.5).orderBy("place").collect()
    want = _greedy([r.route_bytes for r in packed], 150)
    assert [r.shard_id for r in packed] == [f"shard-{n:04d}" for n in want]
    assert packed[0].route_bytes == len('{"r0":[' + ",".join(["[0.5,1.5]"] * points[0]) + "]}")


def test_merged_spans_are_entered_like_their_spans_in_a_row():
    """Tables merged in levels leave the state that one table after the other does, from every state that can enter."""
    rng = random.Random(12)
    for _ in range(200):
        target, width = rng.randint(1, 30), rng.randint(1, 40)
        edges = np.cumsum([rng.choice([1, 2, 5, 60]) for _ in range(rng.randint(1, 60))])
        rows = pd.DataFrame({"low": np.r_[0, edges[:-1]], "high": edges})
        rows["span"] = rows["low"] // width
        tables = pd.concat([R._crossings(g, target, width) for _, g in rows.groupby("span")])
        own = tables[["span", "high", "exit_limit", "opened"]]
        one = R._merged(own.assign(above=0), target, width)
        last = own["span"].max() + 1
        closing = pd.DataFrame({"span": [last], "high": [1 << 60], "exit_limit": [0], "opened": [1]})
        leaves = []
        for tables in (own, one.assign(span=0)):
            state = pd.concat([tables, closing])[["span", "high", "exit_limit", "opened"]].assign(limit=-1, shard=-1)
            leaves.append(R._chain(state).set_index("span").loc[last].tolist())
        assert leaves[0] == leaves[1]


def test_packing_rejects_bad_limits(spark):
    empty = spark.createDataFrame([], "place bigint, route_key string, coordinates array<array<double>>")
    for limits in ((0, 1.0), (1, 0.0)):
        with pytest.raises(ValueError):
            R.pack_shards(empty, *limits)
    assert R.pack_shards(empty, 10, 1.0).count() == 0


def test_trips_without_a_pair_do_not_meet_in_one_partition(spark):
    rows = [(i, None, "BikePoints_1") for i in range(2000)] + [(i, "BikePoints_1", "BikePoints_1") for i in range(2000, 3000)]
    trips = spark.createDataFrame(rows, "journey_id bigint, start_bikepoint_id string, end_bikepoint_id string")
    lookup = spark.createDataFrame([("a|b", None, 1.0)], "route_key string, shard_id string, distance_meters double")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = R.route_join(trips, lookup)
        held = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) > 1 and max(r["count"] for r in held) < 1500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert joined.count() == 3000 and joined.filter("route_key IS NOT NULL OR route_reversed").count() == 0
