from __future__ import annotations

import gzip
import hashlib
import io
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from velospan.operators.replay import locate_trips, playback_trips, replay_trips
from velospan.operators.routes import load_routes, merge_providers, pack_shards, route_join, route_lookup, single_provider
from velospan.plans import export as E
from velospan.sources import route_cache
from tests.test_routes import LINE, cache
from tests.test_stations_pairs import STATIONS, master


def trips(spark, rows):
    """Trips from (id, start, seconds, start id, end id) rows."""
    schema = "journey_id string, bike_id string, bike_model string, start_at timestamp_ntz, end_at timestamp_ntz, start_station_id string, start_station_name string, end_station_id string, end_station_name string, duration_seconds bigint"
    return spark.createDataFrame(
        [(j, "b", None, at, at + timedelta(seconds=s), a, f"S{a}", b, f"S{b}", s) for j, at, s, a, b in rows], schema
    )


def stations(spark):
    plain = master(spark, STATIONS)
    return plain.withColumns(
        {"installed": F.lit(True), "locked": F.lit(None).cast("boolean"), "temporary": F.lit(False), "nb_docks": F.lit(5).cast("bigint")}
    )


def sample(spark):
    at = datetime(2024, 1, 1, 8)
    rows = [("t2", at + timedelta(seconds=1), 60, "3", "1"), ("t1", at, 60, "1", "3"), ("t3", at, 60, "1", "404")]
    rows += [("u1", at + timedelta(days=1), 60, "404", "405")]
    routes = merge_providers(load_routes(cache(spark, [("BikePoints_1", "BikePoints_3", LINE, None, 1, 9.0)])))
    return trips(spark, rows), routes


def test_exported_documents(spark, tmp_path):
    trip_rows, routes = sample(spark)
    root = str(tmp_path / "out")
    row, entries = E.export(trip_rows, stations(spark), routes, "all", root)

    days = {(r.id, r.part): r for r in E.load_day(spark, root).collect()}
    assert sorted(days) == [("2024-01-01", 0), ("2024-01-01", 1), ("2024-01-02", 0)]
    first, morning = days["2024-01-01", 0].asDict(True), days["2024-01-01", 1].asDict(True)
    assert first["trips"] == [] and morning["stations"] == morning["activity"] == [] and morning["summary"] == first["summary"]
    assert [t["id"] for t in morning["trips"]] == ["t1", "t2"]
    assert morning["trips"][1]["routeReversed"] and morning["trips"][1]["routeKey"] == "BikePoints_1|BikePoints_3"
    assert morning["trips"][0]["routeShard"] == "shard-0000" and morning["trips"][0]["bikeModel"] is None
    assert first["summary"] == {"totalTrips": 3, "matchedTrips": 2, "unmatchedTrips": 1, "stationCount": 2, "routedTrips": 2}
    assert [s["stationId"] for s in first["stations"]] == ["1", "3"] and first["stations"][0]["tripCount"] == 3
    assert len(first["activity"]) == 288 and first["activity"][96] == {"time": 28800, "activeTrips": 2}
    empty = days["2024-01-02", 0].asDict(True)
    assert empty["trips"] == [] and empty["stations"] == [] and empty["summary"]["totalTrips"] == 1

    entry = next(d for d in row.first().days if d.date == "2024-01-01")
    text = (tmp_path / "out" / entry.path).read_bytes()
    assert list(json.loads(text)) == ["date", "stations", "trips", "activity", "summary"]
    assert (entry.hash, entry.bytes) == (hashlib.sha256(text).hexdigest()[:12], len(text))
    assert entry.path == f"days/2024-01-01.{entry.hash}.json" and entry.gzipPath == entry.path + ".gz"
    assert 0 < entry.gzipBytes < entry.bytes and (entry.trips, entry.routedTrips) == (2, 2)

    assert [(x.slice, x.trips, x.routedTrips) for x in entry.slices] == [(0, 0, 0), (1, 2, 2)]
    assert entry.slices[0].path == entry.path and entry.slices[1].path.startswith("days/2024-01-01-0001.")

    written = json.loads((tmp_path / "out/manifest.json").read_text())
    assert json.loads(gzip.decompress((tmp_path / "out/manifest.json.gz").read_bytes())) == written
    assert written["dateRange"] == {"minDate": "2024-01-01", "maxDate": "2024-01-02", "tripCount": 4}
    assert written["files"]["routes"]["routeCount"] == 1 and written["files"]["routes"]["shards"][0]["id"] == "shard-0000"
    assert written["files"]["bikepoints"]["stationCount"] == 3
    wanted = spark.createDataFrame([("shard-0000", "BikePoints_1|BikePoints_3"), ("shard-0000", "x|y")], "shard_id string, route_key string")
    assert E.load_shard(spark, root, wanted).select("coordinates").collect() == [([[0.0, 1.0], [2.0, 3.5]],)]
    document = json.loads((tmp_path / "out" / written["files"]["bikepoints"]["path"]).read_text())
    assert [s["bikepointNumber"] for s in document["stations"]] == ["1", "100", "3"]
    assert document["stations"][0] == {
        "bikepointId": "BikePoints_1", "bikepointNumber": "1", "name": "River Street , Clerkenwell", "terminalName": "0100",
        "coord": [0.0, 51.5], "installed": True, "locked": None, "temporary": False, "nbDocks": 5,
    }
    check_files(tmp_path / "out", written)
    assert {r.path for r in entries.collect()} == {f["path"] for f in listed_files(written)}


def listed_files(written):
    slices = [s for d in written["days"] for s in d["slices"]]
    return [*slices, *written["days"], *written["files"]["routes"]["shards"], *written["files"]["bikepoints"]["files"]]


def check_files(root, written):
    """Every path of the manifest can be opened, and is what its name, hash and sizes say."""
    for file in listed_files(written):
        plain, packed = (root / file["path"]).read_bytes(), (root / file["gzipPath"]).read_bytes()
        assert gzip.decompress(packed) == plain and (file["bytes"], file["gzipBytes"]) == (len(plain), len(packed))
        assert hashlib.sha256(plain).hexdigest()[:12] == file["hash"] == file["path"].split(".")[-2]
    assert not [p for p in root.rglob(".*") if not p.name.endswith(".crc")]



def test_chosen_days_and_limit(spark, tmp_path):
    trip_rows, routes = sample(spark)
    wanted = [date(2024, 1, 5), date(2024, 1, 1), date(2024, 1, 5)]
    row = E.export(trip_rows, stations(spark), routes, "all", str(tmp_path / "a"), wanted)[0].first()
    assert [(d.date, d.trips) for d in row.days] == [("2024-01-01", 2), ("2024-01-05", 0)]
    limited = E.export(trip_rows, stations(spark), routes, "all", str(tmp_path / "b"), limit_days=1)[0].first()
    assert [d.date for d in limited.days] == ["2024-01-01"] and limited.dateRange.tripCount == 4


def test_every_day_is_cut_the_same_way_and_counts_add_up(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(f"n{i}", at + timedelta(seconds=i * 400), 60, "1", "3") for i in range(200)]
    rows += [(f"burst{i}", at + timedelta(hours=20), 60, "1", "404" if i % 3 else "3") for i in range(30)]
    rows += [("later", at + timedelta(days=3, hours=23), 60, "1", "3")]
    row = E.export(trips(spark, rows), stations(spark), sample(spark)[1], "all", str(tmp_path / "s"), slice_seconds=900)[0].first()
    first, later = row.days
    assert len(first.slices) > 80 and [x.slice for x in later.slices] == [0, 92]
    for day in row.days:
        assert sum(x.trips for x in day.slices) == day.trips and sum(x.routedTrips for x in day.slices) == day.routedTrips
    assert (first.trips, later.trips) == (210, 1)
    documents = E.load_day(spark, str(tmp_path / "s")).select("id", "part", F.size("trips").alias("n")).collect()
    assert {(r.id, r.part): r.n for r in documents} == {(d.date, x.slice): x.trips for d in row.days for x in d.slices}


def test_every_station_page_is_listed(spark, tmp_path):
    pages = E.station_master_document(stations(spark), 2)
    assert [r.stations_in_document for r in pages.orderBy("part").collect()] == [2, 1]
    trip_rows, routes = sample(spark)
    row = E.export(trip_rows, stations(spark), routes, "all", str(tmp_path / "p"))[0].first()
    assert [f.stationCount for f in row.files.bikepoints.files] == [3] and row.files.bikepoints.files[0].path == row.files.bikepoints.path


def test_shard_documents_keep_one_entry_per_key(spark):
    rows = [("a", "b", LINE, None, 1, 1.0), ("a", "c", LINE, None, 1, 1.0), ("a", "b", '{"coordinates":[[9,9]]}', None, 1, 1.0)]
    routes = single_provider(load_routes(cache(spark, rows)))
    document = E.shard_documents(routes, pack_shards(routes), "mapbox").first()
    assert document.path.startswith("routes/mapbox-cycling-v1/shard-0000.") and document.routes_in_shard == 2
    assert json.loads(document.json) == {
        "version": 1, "encoding": "geojson-coordinate-array", "routes": {"a|b": [[9.0, 9.0]], "a|c": [[0.0, 1.0], [2.0, 3.5]]}
    }
    assert list(json.loads(document.json)["routes"]) == ["a|b", "a|c"]


def test_route_cache_appends_and_snapshots(spark, tmp_path):
    schema = "pair_from string, pair_to string, from_name string, to_name string, from_lon double, from_lat double, to_lon double, to_lat double, trips bigint, response string, failure_type string, failure_message string"
    good = '{"code":"Ok","uuid":"u","routes":[{"distance":5.5,"duration":2,"geometry":{"type":"LineString","coordinates":[[1,2]]}},{"distance":9}]}'
    base = ("a", "b", "A", "B", 1.0, 2.0, 3.0, 4.0, 6)
    rows = [(*base, good, None, None), (*base, '{"routes":[]}', None, None), (*base, None, "TimeoutError", "late")]
    path = str(tmp_path / "cache")
    for row in rows:
        one = spark.createDataFrame([row], schema)
        route_cache.append_routes(route_cache.parse_route_responses(one, "mapbox"), path)
    lines = route_cache.read_route_lines(spark, path)
    first, second, third = route_cache.route_cache_snapshot(lines).orderBy("ordinal").collect()
    assert (first.distance_meters, first.duration_seconds, first.code, first.error) == (5.5, 2.0, "Ok", "null")
    assert json.loads(first.geometry)["coordinates"] == [[1.0, 2.0]] and json.loads(first.from_coord) == [1.0, 2.0]
    assert (second.geometry, second.error, second.distance_meters) == ("null", "null", None)
    assert third.code == "FetchError" and json.loads(third.error) == {"type": "TimeoutError", "message": "late"}
    assert [r.route_key for r in load_routes(route_cache.route_cache_snapshot(lines)).collect()] == ["a|b"]


def test_a_cache_is_read_in_the_order_it_was_appended(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "pair_from string, pair_to string, from_name string, to_name string, from_lon double, from_lat double, to_lon double, to_lat double, trips bigint, response string, failure_type string, failure_message string"
    for batch in range(2):
        rows = [(f"{batch:02}{i:05}", "b", "A", "B", 1.0, 2.0, 3.0, 4.0, i, '{"routes":[]}', None, None) for i in range(4000)]
        # The last partition is the smallest and ends first.
        frame = spark.createDataFrame(rows, schema).repartitionByRange(7, "pair_from").sortWithinPartitions("pair_from")
        route_cache.append_routes(route_cache.parse_route_responses(frame, "mapbox"), path)
    got = [r.pair_from for r in route_cache.read_route_lines(spark, path).orderBy("ordinal").select("pair_from").collect()]
    assert got == sorted(got) and len(got) == 8000


def data_folder(spark, root, trip_rows, google=(), mapbox=()):
    trip_rows.withColumn("source_key", F.lit("a.csv")).write.mode("overwrite").parquet(f"{root}/validated/trips_by_file/source_part=a.csv")
    stations(spark).write.mode("overwrite").parquet(f"{root}/reference/bikepoints/bikepoints.parquet")
    for name, rows in (("google_bicycle", google), ("mapbox_cycling", mapbox)):
        if rows:
            cache(spark, rows).write.mode("overwrite").parquet(f"{root}/reference/routes/{name}/routes.parquet")


def test_only_what_changed_is_exported_again(spark, tmp_path):
    root, out = str(tmp_path / "data"), tmp_path / "out"
    at = datetime(2024, 1, 1, 8)
    rows = [(f"t{d}{i}", at + timedelta(days=d, hours=i), 60, "1", "3") for d in range(3) for i in range(3)]
    google = [("BikePoints_1", "BikePoints_3", LINE, None, 1, 9.0)]
    data_folder(spark, root, trips(spark, rows), google)

    def run(**more):
        entries = E.run_export(spark, root, str(out), **more).collect()
        written = json.loads((out / "manifest.json").read_text())
        check_files(out, written)
        assert {r.path for r in entries} == {f["path"] for f in listed_files(written)}
        assert [d["date"] for d in written["days"]] == sorted({r.id for r in entries if r.kind == "day"})
        return {(r.kind, r.id, r.part) for r in entries if r.written}, written

    first, manifest = run()
    assert len(first) == 3 * 2 + 2 and manifest["files"]["routes"]["routeCount"] == 1
    stamps = {p: p.stat().st_mtime_ns for p in out.rglob("*.json*") if "manifest" not in p.name}
    again, same = run()
    assert again == set() and same["days"] == manifest["days"]
    # One day has another trip: only its slices change.
    data_folder(spark, root, trips(spark, [*rows, ("new", at + timedelta(days=1), 90, "3", "1")]), google)
    changed, manifest = run()
    assert changed == {("day", "2024-01-02", 0), ("day", "2024-01-02", 1)}
    assert [d["trips"] for d in manifest["days"]] == [3, 4, 3]
    assert all(p.stat().st_mtime_ns == stamp for p, stamp in stamps.items())
    days = {(r.id, r.part): len(r.trips) for r in E.load_day(spark, str(out)).collect()}
    assert days[("2024-01-02", 1)] == 4 and len(days) == 6
    # A file that has gone is written again, with the other slices of its day left as they are.
    lost = next(s for s in manifest["days"][0]["slices"] if s["slice"] == 1)["path"]
    (out / lost).unlink()
    assert run()[0] == {("day", "2024-01-01", 1)}
    # Another provider's cache overrides: days with routes, and the shard, are new.
    data_folder(spark, root, trips(spark, rows), google, [("BikePoints_1", "BikePoints_3", '{"coordinates":[[9,9],[8,8]]}', None, 1, 4.0)])
    other, manifest = run()
    assert ("shard", "shard-0000", 0) in other and ("stations", "stations", 0) not in other
    assert manifest["files"]["routes"]["provider"] == "all"
    # A provider without a cache has no routes, and no shard.
    assert run(provider="mapbox")[1]["files"]["routes"]["routeCount"] == 1
    assert run(provider="google", days=[date(2024, 1, 2)])[1]["files"]["routes"]["provider"] == "google"


def test_a_missing_cache_counts_as_empty(spark, tmp_path):
    root, out = str(tmp_path / "data"), tmp_path / "out"
    data_folder(spark, root, sample(spark)[0])
    entries = E.run_export(spark, root, str(out), provider="mapbox").collect()
    written = json.loads((out / "manifest.json").read_text())
    assert written["files"]["routes"]["shards"] == [] and written["files"]["routes"]["routeCount"] == 0
    assert {r.kind for r in entries} == {"day", "stations"} and [d["routedTrips"] for d in written["days"]] == [0, 0]
    check_files(out, written)


def test_files_are_whole_or_absent_and_repeat_safely(spark, tmp_path):
    from velospan.sources import files

    rows = [("a/x.1.json", "one"), ("a/y.2.json", "zwei é"), ("b/z.3.json", "3")]
    frame = spark.createDataFrame(rows, "path string, content string")
    for _ in range(2):
        sizes = {r.path: r.gzip_bytes for r in files.write_files(frame, str(tmp_path / "w")).collect()}
    for path, text in rows:
        assert (tmp_path / "w" / path).read_bytes() == text.encode()
        packed = (tmp_path / "w" / f"{path}.gz").read_bytes()
        assert gzip.decompress(packed) == text.encode() and sizes[path] == len(packed)
    # A file cut short by something else is mended, a fixed name is replaced on demand only.
    (tmp_path / "w/a/y.2.json").write_bytes(b"z")
    files.write_files(frame, str(tmp_path / "w"))
    assert (tmp_path / "w/a/y.2.json").read_text() == "zwei é"
    other = spark.createDataFrame([("a/x.1.json", "two")], "path string, content string")
    files.write_files(other, str(tmp_path / "w"))
    assert (tmp_path / "w/a/x.1.json").read_text() == "one"
    files.write_files(other, str(tmp_path / "w"), replace=True)
    assert (tmp_path / "w/a/x.1.json").read_text() == "two"
    found = {r.path: r.length for r in files.listed(spark, str(tmp_path / "w")).collect()}
    assert found["a/x.1.json"] == 3 and len(found) == 6
    assert files.listed(spark, str(tmp_path / "none")).count() == 0 and not files.has_files(spark, str(tmp_path / "none"))


def test_no_row_of_a_day_grows_with_it(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 1, 8)
    rows = [(f"t{i:05}", at + timedelta(seconds=i % 50), 60, "1", "3") for i in range(3000)] + [("t00007", at + timedelta(seconds=7), 90, "3", "1")]
    routed = route_join(locate_trips(playback_trips(trips(spark, rows)), stations(spark)), route_lookup(sample(spark)[1]))
    matches = E.station_matches(routed, stations(spark), F.col("day"))
    summary = E.day_summary(routed, routed, stations(spark), matches=matches)
    assert summary.collect() == E.day_summary(routed, routed, stations(spark)).collect()
    pieces = E.day_documents(replay_trips(routed), E.station_records(matches, "day"), E.activity_bins(routed), summary)
    assert pieces.filter("trip IS NOT NULL").count() == 3001 and pieces.count() == 3001 + 2 + 2 * 3
    # Files are packed and pieces come in many parts.
    monkeypatch.setattr("velospan.sources.files.PART_BYTES", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        written = {r.part: r for r in E.write_days(pieces, str(tmp_path / "d")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(p, r.trips_in_slice, r.routed_in_slice) for p, r in written.items()} == {(0, 0, 0), (1, 3001, 3001)}
    assert {(r.part, r.trips_in_slice, r.routed_in_slice) for r in E.day_counts(pieces).collect()} == {(0, 0, 0), (1, 3001, 3001)}
    for r in written.values():
        text = (tmp_path / "d" / r.path).read_bytes()
        assert (r.hash, r.bytes) == (hashlib.sha256(text).hexdigest()[:12], len(text)) and r.path.split(".")[-2] == r.hash
        packed = (tmp_path / "d" / f"{r.path}.gz").read_bytes()
        assert gzip.decompress(packed) == text and len(packed) == r.gzip_bytes
    document = json.loads((tmp_path / "d" / written[1].path).read_bytes())
    keys = [(t["start"], t["id"], t["durationSeconds"]) for t in document["trips"]]
    assert keys == sorted(keys) and len(keys) == 3001
    assert not list((tmp_path / "d").rglob(".*"))


def test_a_row_of_files_is_a_batch_of_its_own(spark, tmp_path, monkeypatch):
    from velospan.sources import files

    seen, plain, name = [], files.staged, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(files, "staged", lambda df, label: seen.append(df.sparkSession.conf.get(name)) or plain(df, label))
    before = spark.conf.get(name)
    files.write_files(spark.createDataFrame([("a.json", "1"), ("b.json", "2")], "path string, content string"), str(tmp_path / "w"))
    assert seen == ["1"] and spark.conf.get(name) == before


def merged(stretches):
    """The document that stretches in their order are made of."""
    whole = {}
    for piece in stretches:
        for name, value in piece.items():
            whole[name] = whole[name] + value if isinstance(value, list) and name in whole else value
    return whole


@pytest.mark.parametrize("part", [3, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_stretches_are_objects_that_hold_everything_once(monkeypatch, part, indent):
    from velospan.sources import files

    monkeypatch.setattr(files, "PART_BYTES", part)
    item = {"id": 'a},{"id":"\\', "at": [1.5, None, -2e30], "in": {"x": [], "é\U0001f6b2": "]}"}}
    document = {"date": "2024-01-01", "n": -12.25e-3, "stations": [], "trips": [item] * 50 + [7, 78.125, None, True], "activity": [{"time": 5}] * 9, "gone": None}
    for text in (json.dumps(document, indent=indent), json.dumps(document, indent=indent, ensure_ascii=False)):
        stretches = [json.loads(t) for t in files._stretches(files._Values(io.BytesIO(text.encode())), ["stations", "trips", "gone"], 200)]
        assert merged(stretches) == document and len(stretches) > 10 and {s["date"] for s in stretches} == {"2024-01-01"}
        assert max(len(s["trips"]) for s in stretches) < 9 and [s for s in stretches if "activity" in s] == stretches[-1:]
        assert list(files._stretches(files._Values(io.BytesIO(b" {} ")), ["trips"], 1)) == ["{}"]
        for broken in (text[:-3], text[:300], text.replace("0.01225", "0.01225 1"), "", "[]"):
            with pytest.raises(ValueError):
                list(files._stretches(files._Values(io.BytesIO(broken.encode())), ["stations", "trips"], 200))


def test_a_day_read_in_stretches_is_the_day_read_whole(spark, tmp_path):
    at, root = datetime(2024, 1, 1, 8), str(tmp_path / "out")
    rows = [(f't}},{{"id":"é{i}' if i else None, at + timedelta(seconds=i), 60, "1", "3") for i in range(300)]
    rows.append(("u1", at + timedelta(days=1), 60, "404", "405"))
    E.export(trips(spark, rows), stations(spark), sample(spark)[1], "all", root)
    whole = {(r.id, r.part): r.asDict(True) for r in E.load_day(spark, root).collect()}
    assert sorted(whole) == [("2024-01-01", 0), ("2024-01-01", 1), ("2024-01-02", 0)]

    def read(**more):
        found = {}
        for r in E.load_day(spark, root, **more).orderBy("id", "part", "stretch").collect():
            row = r.asDict(True)
            slices = found.setdefault((row.pop("id"), row.pop("part")), [])
            assert row.pop("stretch") == len(slices)
            slices.append({k: v for k, v in row.items() if v is not None})
        return found

    stretches = read(characters=3000)
    assert {k: {"id": k[0], "part": k[1], **merged(v)} for k, v in stretches.items()} == whole
    # No row grows with the day, and none is cut off.
    assert len(stretches["2024-01-01", 1]) > 20 and max(len(s["trips"]) for s in stretches["2024-01-01", 1]) < 10
    assert {k: len(v) for k, v in read(characters=1 << 20).items()} == dict.fromkeys(whole, 1)
    assert sorted(read(day=date(2024, 1, 2), characters=1)) == [("2024-01-02", 0)] and read(day=date(2024, 1, 3), characters=1) == {}
    # A document that has gone gives no row, read either way.
    next((tmp_path / "out/days").glob("2024-01-02.*.json")).unlink()
    assert sorted(read(characters=3000)) == sorted((r.id, r.part) for r in E.load_day(spark, root).collect()) == sorted(whole)[:2]


def test_the_query_holds_no_document(spark, tmp_path, monkeypatch):
    from workload import queries

    at, root = datetime(2024, 1, 1, 8), str(tmp_path / "out")
    rows = [(f"t{i:03}", at + timedelta(hours=i % 12), 60, "1", "3") for i in range(200)]
    E.export(trips(spark, [*rows, ("u1", at + timedelta(days=1), 60, "404", "405")]), stations(spark), sample(spark)[1], "all", root)
    monkeypatch.setattr(queries, "_exported", lambda t: (root, None))
    monkeypatch.setattr(E, "STRETCH_CHARACTERS", 2000)
    found = queries.QUERIES["load_day"](spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "/days/" in f]
    expected = [("2024-01-01", 200, "t000", sum(((8 + i % 12) * 3600 + 60) for i in range(200)), 200, 288, 200), ("2024-01-02", 0, None, None, 0, 288, 1)]
    assert [tuple(r) for r in found.orderBy("day").collect()] == expected
