from __future__ import annotations

import io
import json
import random
import zipfile
import zlib
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from velospan.plans import catalog, ingest
from velospan.plans import ledger as L
from velospan.sources import trip_files
from velospan.sources.listing import read_listing
from velospan.sources.station_master import flatten_stations, read_station_master
from velospan.operators.normalize import normalize_trips
from velospan.sources.trip_files import read_trip_csv, scan_csv
from velospan.sources.trips import scan_trips, write_by_source

OLD = "Rental Id,Bike Id,Start Date,End Date,StartStation Id,StartStation Name,EndStation Id,EndStation Name,Duration"
NEW = "Number,Start date,Start station number,Start station,End date,End station number,End station,Bike number,Bike model,Total duration (ms)"


def old_row(number, end="10:10", duration="600", name="River Street"):
    return f'{number},7,01/02/2020 10:00,01/02/2020 {end},1,"{name}",2,High Road,{duration}'


def new_row(number):
    return f"{number},2023-02-01 10:00,001,River Street,2023-02-01 10:05,2,High Road,9,CLASSIC,300000"


def page(objects, note=""):
    rows = "".join(
        f"<Contents><Key>{k}</Key><LastModified>{m}</LastModified><ETag>&quot;{e}&quot;</ETag><Size>{s}</Size></Contents>"
        for k, s, m, e in objects
    )
    return f'<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Name>b{note}</Name>{rows}</ListBucketResult>'


def packed(members):
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return content.getvalue()


class Landing:
    def __init__(self, root):
        self.root, self.pages = root, root / "listing.xml"
        self.objects = {}

    def put(self, key, content, etag="1", size=None):
        path = self.root / "raw" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        self.objects[key] = (key, path.stat().st_size if size is None else size, "2024", etag)
        self.pages.write_text(page([("usage/", 0, "2024", "x"), *self.objects.values()]))

    def states(self, spark):
        rows = ingest.current_ledger(spark, str(self.root)).collect()
        return {r.source_key.removeprefix("usage/"): r for r in rows}


def test_whole_ingest(spark, tmp_path):
    root, land = str(tmp_path), Landing(tmp_path)
    flat = "\n".join([OLD, old_row(1), old_row(2), old_row(2), "", old_row(3, end="09:00")]) + "\n"
    land.put("usage/a b+c.csv", flat)
    land.put("usage/quoted.csv", "\n".join([NEW, new_row(10).replace("River Street", '"River\nStreet, ""A"""'), new_row(11)]))
    land.put("usage/unknown.csv", "X,Y\n1,2\n")
    land.put("usage/bytes.csv", (OLD + "\n" + old_row(4, name="Caf\xe9")).encode("cp1252"))
    land.put("usage/book.xlsx", b"PK")
    land.put("usage/bad.zip", b"not a zip")
    cafe = (OLD + "\r\n" + old_row(20, name="Caf\xe9") + "\r\n").encode("cp1252")
    land.put("usage/pack.zip", packed({"dup.csv": flat, "x/READ.CSV": cafe, "new.csv": "﻿" + NEW + "\n" + new_row(21), "note.txt": "-"}))
    land.put("usage/dup.zip", packed({"copy.csv": flat}))
    land.put("usage/short.csv", OLD + "\n", size=5)
    land.put("usage/empty.csv", "")
    land.put("usage/all-bad.csv", OLD + "\n" + old_row(1, end="09:00"))

    plan = ingest.run_raw(spark, root, str(land.pages), prefix="usage/")
    assert plan.count() == 10  # the empty object is not listed
    states = land.states(spark)
    assert states["short.csv"].raw_status == "failed" and "listed 5 bytes" in states["short.csv"].error_message
    assert states["a b+c.csv"].raw_status == "downloaded" and states["a b+c.csv"].raw_path == "raw/usage/a b+c.csv"

    ingest.run_normalize(spark, root)
    states = land.states(spark)
    got = {k: (r.normalized_status, r.row_count_raw, r.row_count_normalized) for k, r in states.items()}
    assert got == {
        "a b+c.csv": ("normalized", 4, 4),
        "quoted.csv": ("normalized", 2, 2),
        "unknown.csv": ("failed", None, None),
        "bytes.csv": ("failed", None, None),
        "book.xlsx": ("failed", None, None),
        "bad.zip": ("failed", None, None),
        "pack.zip": ("normalized", 2, 2),
        "dup.zip": ("skipped", 0, 0),
        "short.csv": ("pending", None, None),
        "all-bad.csv": ("normalized", 1, 1),
    }
    assert states["unknown.csv"].error_message == "no layout has these columns: X, Y"
    assert states["dup.zip"].error_message == L.ALL_DUPLICATES
    assert states["book.xlsx"].error_message.endswith(" .xlsx")

    normalized = {
        (r.source_key, r.source_member, r.source_row_number): r
        for r in spark.read.parquet(f"{root}/{ingest.NORMALIZED}").collect()
    }
    assert normalized["usage/a b+c.csv", None, 4].journey_id == "3"
    assert normalized["usage/quoted.csv", None, 1].start_station_name == 'River\nStreet, "A"'
    assert normalized["usage/quoted.csv", None, 2].duration_seconds == 300
    assert normalized["usage/pack.zip", "x/READ.CSV", 1].start_station_name == "Caf\xe9"
    assert normalized["usage/pack.zip", "new.csv", 1].bike_model == "CLASSIC"

    ingest.run_validate(spark, root)
    states = land.states(spark)
    got = {k: (r.validated_status, r.row_count_validated, r.row_count_invalid) for k, r in states.items()}
    assert got["a b+c.csv"] == ("validated", 1, 3)
    assert got["all-bad.csv"] == ("failed", 0, 1)
    assert got["quoted.csv"] == ("validated", 2, 0) and states["quoted.csv"].invalid_path is None
    assert got["unknown.csv"] == ("pending", None, None)
    assert scan_trips(spark, f"{root}/{ingest.VALIDATED}").count() == 5

    # A changed file is planned again, and its rejects of the first run go away.
    assert ingest.run_raw(spark, root, str(land.pages), prefix="usage/").count() == 1
    land.put("usage/a b+c.csv", "\n".join([OLD, old_row(1), old_row(2)]), etag="2")
    assert ingest.run_raw(spark, root, str(land.pages), prefix="usage/").count() == 2
    assert land.states(spark)["a b+c.csv"].row_count_validated is None
    ingest.run_normalize(spark, root)
    outcomes = ingest.run_validate(spark, root)
    assert [(r.valid_rows, r.invalid_rows) for r in outcomes.collect()] == [(2, 0)]
    rejected = spark.read.parquet(f"{root}/{ingest.REJECTED}")
    assert [r.source_key for r in rejected.select("source_key").distinct().collect()] == ["usage/all-bad.csv"]

    stations = [
        {"id": "BikePoints_1", "commonName": "River Street", "lat": 51.5, "lon": -0.1, "additionalProperties": []},
        {"id": "BikePoints_2", "commonName": " High Road ", "lat": 51.6, "lon": -0.2},
    ]
    (tmp_path / "stations.json").write_text(json.dumps(stations, indent=2))
    samples = ingest.run_stations(spark, root, str(tmp_path / "stations.json"), [date(2020, 2, 1)])
    assert {r.station_id: r.match_method for r in samples.collect()} == {"1": "bikepoint_number", "2": "bikepoint_number"}

    assert catalog.register_views(spark, root) == ["trips", "normalized_trips", "bikepoints", "station_match_samples"]
    assert catalog.run_sql(spark, "SELECT count(*) AS n FROM trips ; ").first().n == 6
    with pytest.raises(FileNotFoundError):
        catalog.register_views(spark, str(tmp_path / "nothing"))


def test_row_numbers_hold_across_splits(spark, tmp_path):
    files = {}
    for name, rows in (("one", 3000), ("two", 17), ("three", 900)):
        lines = [NEW if name == "two" else OLD] + [new_row(i) if name == "two" else old_row(i) for i in range(1, rows + 1)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        files[name] = rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        paths = [str(tmp_path / f"{n}.csv") for n in files]
        scan = scan_csv(spark, paths)
        assert scan.profile.count() > 10
        # Read with other splits than those that were profiled.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        rows = read_trip_csv(spark, paths, scan).withColumn("name", F.regexp_extract("file", r"(\w+)\.csv$", 1))
        wrong = rows.filter(F.col("source_row_number") != F.get("fields", 0).cast("bigint"))
        assert wrong.count() == 0
        assert {r.name: r["count"] for r in rows.groupBy("name").count().collect()} == files
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blocks_without_a_profile_are_an_error(spark, tmp_path):
    (tmp_path / "one.csv").write_text("\n".join([OLD, *[old_row(i) for i in range(1, 50)]]) + "\n")
    scan = scan_csv(spark, [str(tmp_path / "one.csv")])
    with pytest.raises(Exception, match="no profile for a block"):
        read_trip_csv(spark, [], replace(scan, profile=scan.profile.filter("block > 0").union(scan.profile.withColumn("block", F.lit(-1).cast("bigint"))))).collect()


def test_blank_header_cells_keep_their_place(spark, tmp_path):
    names, cells = OLD.split(","), old_row(1).split(",")
    for place in (0, 2, len(names)):
        header, row = [*names[:place], "", *names[place:]], [*cells[:place], "odd", *cells[place:]]
        (tmp_path / f"b{place}.csv").write_text("\n".join([",".join(header), ",".join(row)]) + "\n")
    (tmp_path / "plain.csv").write_text(f"{OLD}\n{old_row(1)}\n")
    rows = read_trip_csv(spark, [str(tmp_path / f"{n}.csv") for n in ("b0", "b2", f"b{len(names)}", "plain")])
    trips = normalize_trips(rows.withColumn("source_key", F.lit("k")).withColumn("source_etag", F.lit("e")))
    assert trips.count() == 4 and trips.distinct().count() == 1
    assert trips.filter("start_at IS NULL OR start_station_name IS NULL OR duration_seconds IS NULL").count() == 0


def test_a_root_below_another_raw_folder(spark, tmp_path):
    landing = Landing(tmp_path / "raw" / "project")
    landing.put("usage/a.csv", "\n".join([OLD, old_row(1)]) + "\n")
    root = str(landing.root)
    ingest.run_raw(spark, root, str(landing.pages), "usage/")
    assert [(r.source_key, r.status) for r in ingest.run_normalize(spark, root).collect()] == [("usage/a.csv", "normalized")]


def test_a_file_that_has_gone_fails_alone(spark, tmp_path):
    landing = Landing(tmp_path / "root")
    for name in ("a.csv", "b.csv", "c[1]{x}*.csv"):
        landing.put(f"usage/{name}", "\n".join([OLD, old_row(1)]) + "\n")
    root = str(landing.root)
    ingest.run_raw(spark, root, str(landing.pages), "usage/")
    (landing.root / "raw/usage/b.csv").rename(tmp_path / "elsewhere")
    got = {r.source_key: (r.status, r.error, r.rows) for r in ingest.run_normalize(spark, root).collect()}
    assert got["usage/b.csv"] == ("failed", "no landed file for usage/b.csv", 0)
    assert got["usage/a.csv"] == got["usage/c[1]{x}*.csv"] == ("normalized", None, 1)


def test_listing_pages(spark, tmp_path):
    (tmp_path / "a.xml").write_text(page([("p/", 0, "d", "x"), ("p/1", 3, "d1", "e1"), ("p/2", 0, "d2", "e2")]))
    (tmp_path / "b.xml").write_text(page([("p/3", 4, "d3", "e3")], "2"))
    got = read_listing(spark, str(tmp_path), "p/").select("source_key", "size_bytes", "last_modified", "etag")
    assert sorted(map(tuple, got.collect())) == [("p/1", 3, "d1", "e1"), ("p/3", 4, "d3", "e3")]
    assert read_listing(spark, str(tmp_path), "p/", include_empty=True).count() == 3
    (tmp_path / "c.xml").write_text("<L><Contents><Key>k</Key><LastModified>d</LastModified></Contents></L>")
    with pytest.raises(Exception, match="a listed object has no Size"):
        read_listing(spark, str(tmp_path)).collect()


def test_station_master_edges(spark, tmp_path):
    item = {
        "id": "BikePoints_0042",
        "commonName": "",
        "lat": 1.0,
        "additionalProperties": [
            {"key": "TerminalName", "value": "1"},
            {"key": "TerminalName", "value": " 0022 "},
            {"key": "Installed", "value": "TRUE"},
            {"key": "Locked", "value": ""},
            {"key": "InstallDate", "value": "1278947280500"},
            {"key": "NbDocks", "value": "19"},
        ],
    }
    (tmp_path / "s.json").write_text(json.dumps([item, {"id": "Other"}]))
    first, second = flatten_stations(read_station_master(spark, str(tmp_path / "s.json"))).orderBy("ordinal").collect()
    assert (first.bikepoint_number, first.bikepoint_number_key, first.terminal_name, first.terminal_name_key) == ("0042", "42", "0022", "22")
    assert (first.installed, first.locked, first.temporary, first.nb_docks, first.common_name) == (True, None, None, 19, None)
    assert str(first.install_date) == "2010-07-12 15:08:00.500000" and first.lon is None
    assert (second.bikepoint_number, second.bikepoint_number_key) == ("Other", None)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="JSON array"):
        read_station_master(spark, str(tmp_path / "bad.json")).collect()


def test_plan_limit_cuts_the_plan_only(spark):
    listing = spark.createDataFrame(
        [("b", 1, "d", "e", 0), ("a", 1, "d", None, 1), ("c", 2, "d", "e", 2)],
        "source_key string, size_bytes bigint, last_modified string, etag string, place int",
    )
    ledger, plan = L.plan_raw(listing, L.empty_ledger(spark), ["place"], 2)
    assert sorted(r.source_key for r in plan.collect()) == ["a", "b"] and ledger.count() == 3
    done = L.apply_outcomes(ledger, spark.createDataFrame([(k, "downloaded", None) for k in "abc"], "source_key string, status string, error string"), "raw")
    again, plan = L.plan_raw(listing.filter("source_key <> 'c'"), done, ["place"])
    assert plan.count() == 0 and again.filter("raw_status = 'downloaded' and raw_downloaded_at is not null").count() == 3
    changed = listing.withColumn("etag", F.when(F.col("source_key") == "a", "new").otherwise(F.col("etag")))
    again, plan = L.plan_raw(changed, done, ["place"])
    assert [r.source_key for r in plan.collect()] == ["a"]
    assert again.filter("source_key = 'a'").select("raw_status", "raw_downloaded_at").first() == ("pending", None)
    assert L.plan_normalize(again).count() == 2 and L.plan_normalize(again, limit=1).first().source_key == "b"


def test_a_source_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("x/1.csv", 1), ("x/1.csv", 2), ("x/2.csv", 3)], "source_key string, v int")
    write_by_source(rows, path)
    write_by_source(rows.filter("v = 2"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    assert (tmp_path / "t" / "source_part=x__1.csv").exists()


def random_csv(rng, newline, rows, header):
    def field():
        kind = rng.random()
        if kind < 0.3:
            return '"' + "".join(rng.choice(["a", ",", '""', newline, newline, "é", " "]) for _ in range(rng.randint(0, 9))) + '"'
        if kind < 0.4:
            return 'x"y' + rng.choice(["", '"'])
        return "" if kind < 0.45 else "".join(rng.choices("abc ", k=rng.randint(1, 5)))

    lines = [header]
    for i in range(rows):
        lines.append(f"{i},{field()},{field()}")
        if rng.random() < 0.05:
            lines.append("")
    return newline.join(lines) + rng.choice(["", newline])


@pytest.fixture()
def small_blocks(spark):
    """Files are read in many blocks."""
    for key, value in (("maxPartitionBytes", "3000"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    yield
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def test_quoted_line_breaks_are_read_in_blocks(spark, tmp_path, small_blocks):
    """Rows, numbers and headers are those of the CSV reader, which reads such a file in one task."""
    rng = random.Random(4)
    headers = ["h1,h2,h3", "h1,h2,h3", 'h1,"h\n2",h3']
    for number, (newline, header) in enumerate(zip(["\n", "\r\n", "\n"], headers)):
        path = tmp_path / f"f{number}.csv"
        path.write_text(random_csv(rng, newline, 700, header), newline="")
        assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 2
    folder = str(tmp_path)
    reader = spark.read.schema("c0 string, c1 string, c2 string").options(header=False, multiLine=True, quote='"', escape='"')
    want = {}
    for r in reader.csv(folder).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect():
        want.setdefault(r.file, []).append([r.c0, r.c1, r.c2])
    got = {}
    for r in trip_files.read_trip_csv(spark, [folder]).orderBy("file", "source_row_number").collect():
        rows = got.setdefault(r.file, [r.header])
        assert r.source_row_number == len(rows)
        rows.append(r.fields)
    assert got == want and len(want) == 3


def test_checksums_of_files_read_in_blocks(spark, tmp_path, small_blocks):
    rng, want = random.Random(5), {}
    for i in range(12):
        content = b"\n".join(rng.randbytes(rng.randint(0, 60)).replace(b"\n", b"") for _ in range(rng.choice([1, 3, 500])))
        content = b"\xef\xbb\xbf" * (i % 3 == 0) + content + b"\n" * (i % 2) if i < 10 else [b"\n\n\n", b"\r\n\xff\r\n"][i - 10]
        (tmp_path / f"f{i}.csv").write_bytes(content)
        want[f"f{i}.csv"] = len(content), zlib.crc32(content)
    found = trip_files.csv_fingerprints(spark, [str(tmp_path)]).collect()
    assert {r.file.rsplit("/", 1)[1]: (r.file_size, r.crc32) for r in found} == want


def test_checksums_join_like_byte_strings():
    rng = random.Random(6)
    for n in (0, 1, 7, 300, 70_000):
        first, second = rng.randbytes(rng.randint(0, 50)), rng.randbytes(n)
        assert trip_files.joined_crc(zlib.crc32(first), zlib.crc32(second), n) == zlib.crc32(first + second)


def test_members_of_one_archive_are_read_apart(spark, tmp_path):
    rng, path = random.Random(7), tmp_path / "many.zip"
    texts = {f"m{i}.CSV": random_csv(rng, rng.choice(["\n", "\r\n"]), 60, "h1,h2,h3") for i in range(5)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in texts.items():
            archive.writestr(name, text.encode("windows-1252" if name == "m3.CSV" else "utf-8"))
        archive.writestr("empty.csv", "")
        archive.writestr("notes.txt", "x")
    rows = trip_files.read_zip_members(spark, [str(path)])
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    got = {}
    for r in rows.orderBy("source_member", "source_row_number").collect():
        assert r.error is None and r.source_row_number == len(got.setdefault(r.source_member, [r.header]))
        # Line ends inside quotes stay as they are; the reader below makes them line feeds.
        got[r.source_member].append([x and x.replace("\r\n", "\n") for x in r.fields])
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, newline="")
        reader = spark.read.schema("c0 string, c1 string, c2 string").options(header=False, multiLine=True, quote='"', escape='"')
        assert got[name] == [list(r) for r in reader.csv(str(tmp_path / f"{name}.csv")).collect()]
    assert set(got) == set(texts)


def test_a_flat_file_is_hashed_once(spark, tmp_path, monkeypatch):
    hashed, real, land = [], ingest.csv_fingerprints, Landing(tmp_path)

    def counted(session, paths):
        hashed.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return real(session, paths)

    monkeypatch.setattr(ingest, "csv_fingerprints", counted)
    text = "\n".join([NEW, new_row(1), new_row(2)])
    land.put("usage/flat.csv", text)
    land.put("usage/other.csv", text + "\n" + new_row(3))
    more = "\n".join([NEW, new_row(8)])
    for name, members in (("a", {"flat.csv": text}), ("b", {"flat.csv": text, "more.csv": more})):
        land.put(f"usage/{name}.zip", packed(members))
        ingest.run_raw(spark, str(tmp_path), str(land.pages), "usage/")
        ingest.run_normalize(spark, str(tmp_path))
    states = land.states(spark)
    assert (states["a.zip"].normalized_status, states["b.zip"].row_count_normalized) == ("skipped", 1)
    # Only the file as long as a member is hashed, and only once.
    assert hashed == [["flat.csv"]]


def test_small_members_share_tasks(spark):
    from velospan.sources import trip_files

    cores = spark.sparkContext.defaultParallelism
    rows = [(f"f{i}.zip", "m.csv", 1000) for i in range(300)]
    small = spark.createDataFrame(rows, "file string, source_member string, file_size bigint")
    dealt = trip_files._dealt(small)
    assert dealt.rdd.getNumPartitions() == 4 * cores and sorted(r.file for r in dealt.collect()) == sorted(r[0] for r in rows)
    large = small.withColumn("file_size", F.lit(trip_files.MEMBER_BYTES))
    assert trip_files._dealt(large).rdd.getNumPartitions() == 300
    assert trip_files._dealt(small.drop("file_size")).rdd.getNumPartitions() == 300
