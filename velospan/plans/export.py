"""Replay export: day, shard and station documents as JSON files named by their content, and the manifest.

Documents of shards and stations are rows (kind, id, part, path, hash, json, bytes). A day
is always cut into the same slices of the clock, each a document of the same shape, whose
trips and stations are rows until they are in its file; stations come in pages. How
documents are cut does not depend on how much there is.

A data folder is exported again by what changed: days whose trips, stations and routes
are those of the export before are not made again, and files that are there already
under the name of their content are not written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.operators.replay import (
    activity_bins,
    date_range,
    day_summary,
    locate_trips,
    playback_trips,
    replay_trips,
    select_days,
    trip_record,
)
from velospan.operators.routes import (
    SHARD_COMPRESSION,
    SHARD_GZIP_BYTES,
    load_routes,
    merge_providers,
    pack_shards,
    route_join,
    route_lookup,
    single_provider,
)
from velospan.operators.running import numbered
from velospan.operators.stations import station_matches, station_records
from velospan.plans.catalog import TABLE_VIEWS, TRIP_VIEWS
from velospan.plans.versions import CURRENT, read_version, write_version
from velospan.schemas import EXPORT_ENTRY, ROUTE_CACHE, nullable
from velospan.sources.files import has_files, listed, qualified, read_stretches, write_files, write_pieces
from velospan.sources.trips import scan_trips
from velospan.staging import staged

# Names and numbers written into the documents.
VERSION = 1
ENCODING = "geojson-coordinate-array"
SHARD_STRATEGY = "cache-order-byte-pack-v1"
STATIONS_PATH = "stations/bikepoints-v1"
HASH_DIGITS = 12
MANIFEST = "manifest.json"
# End of fixed values.

#: Seconds of a slice of the day and stations of a page: documents at every size are cut the same way.
SLICE_SECONDS = 6 * 3600
PAGE_STATIONS = 200_000
#: Characters of stations and trips in a row, where a day is read back in stretches.
STRETCH_CHARACTERS = 1 << 20

#: Where a data folder keeps what it exported, a table of entries per folder exported to.
EXPORTS = "metadata/exports"

_AS_WRITTEN = {"ignoreNullFields": "false"}
#: What the pieces of a day's document are, in their order, and what they count.
_HEAD, _STATION, _BETWEEN, _TRIP, _TAIL = range(5)
_COUNTS = ["trips_in_slice", "routed_in_slice"]


def _documents(df: DataFrame, kind: str, name: Column, path: Column, json: Column, *counts: str) -> DataFrame:
    """Rows of one kind of document, each named by the hash of its content."""
    digest = F.substring(F.sha2("json", 256), 1, HASH_DIGITS)
    return (
        df.select(F.lit(kind).alias("kind"), name.alias("id"), "part", path.alias("stem"), json.alias("json"), *counts)
        .withColumn("hash", digest)
        .withColumn("path", F.concat("stem", F.lit("."), "hash", F.lit(".json")))
        .withColumn("bytes", F.octet_length("json").cast("bigint"))
        .drop("stem")
    )


def _part_suffix() -> Column:
    """Nothing for the only or first part, ``-0001`` and so on after it."""
    return F.when(F.col("part") > 0, F.format_string("-%04d", "part")).otherwise(F.lit(""))


def with_parts(replay: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add ``part``: the slice of the clock that a trip starts in."""
    return replay.withColumn("part", F.floor(F.col("start_second") / slice_seconds).cast("int"))


def day_documents(
    replay: DataFrame, stations: DataFrame, activity: DataFrame, summary: DataFrame, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """One document per slice of a day: trips by start then id, stations, activity, summary.

    ``stations`` are ``station_records`` with ``day``. Every day has a first slice, which
    carries its stations and activity; later ones exist where trips start in them, and
    carry their trips and the day's summary. Each counts its own trips.

    A document is a row per trip, per station and per text between them, in no order
    (``write_days`` brings them in order), so that no row grows with the day.
    """
    point = F.struct("time", F.col("active_trips").alias("activeTrips"))
    bins = activity.groupBy("day").agg(F.to_json(F.array_sort(F.collect_list(point)), _AS_WRITTEN).alias("activity"))
    totals = F.struct(
        F.col("total_trips").alias("totalTrips"),
        F.col("matched_trips").alias("matchedTrips"),
        F.col("unmatched_trips").alias("unmatchedTrips"),
        F.col("station_count").alias("stationCount"),
        F.col("routed_trips").alias("routedTrips"),
    )
    dated = summary.filter(F.col("day").isNotNull())
    days = staged(dated.select("day", F.to_json(totals, _AS_WRITTEN).alias("summary")), "day-totals")
    own = with_parts(replay, slice_seconds).join(days.select("day"), "day", "left_semi")
    # A day without a matched trip still has its (empty) first part.
    parts = staged(days.select("day", F.lit(0).alias("part")).union(own.filter("part > 0").select("day", "part").distinct()), "day-parts")
    first = F.coalesce(F.when(F.col("part") == 0, F.col("activity")), F.lit("[]"))
    head = F.concat(F.lit('{"date":"'), F.col("day").cast("string"), F.lit('","stations":['))
    tail = F.concat(F.lit('],"activity":'), first, F.lit(',"summary":'), F.col("summary"), F.lit("}"))

    def text(of: DataFrame, section: int, value: Column) -> DataFrame:
        return of.select("day", "part", F.lit(section).alias("section"), value.alias("text"))

    ended = parts.join(days, "day").join(bins, "day", "left")
    between = text(parts, _HEAD, head).union(text(parts, _BETWEEN, F.lit('],"trips":['))).union(text(ended, _TAIL, tail))
    trips = own.select(
        "day",
        "part",
        F.lit(_TRIP).alias("section"),
        "start_at",
        "journey_id",
        trip_record().alias("trip"),
        F.lit(1).cast("bigint").alias("trips_in_slice"),
        F.col("route_key").isNotNull().cast("bigint").alias("routed_in_slice"),
    )
    drawn = stations.join(days.select("day"), "day", "left_semi").select(
        "day",
        F.lit(0).alias("part"),
        F.lit(_STATION).alias("section"),
        (-F.col("tripCount")).alias("rank"),
        F.col("id").alias("station_id"),
        F.struct(*[c for c in stations.columns if c != "day"]).alias("station"),
    )
    pieces = between.unionByName(trips, allowMissingColumns=True).unionByName(drawn, allowMissingColumns=True)
    counts = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in _COUNTS}
    return pieces.select(F.lit("day").alias("kind"), F.col("day").cast("string").alias("id"), "*").withColumns(counts).drop("day")


def day_counts(pieces: DataFrame) -> DataFrame:
    """One row per document of ``day_documents``: what it counts."""
    return pieces.groupBy("kind", "id", "part").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def write_days(pieces: DataFrame, root: str) -> DataFrame:
    """Write the documents of ``day_documents``, and gzip copies; returns a row for each with its counts, path, hash and sizes."""
    document = ["id", "part"]
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["section", "start_at", "journey_id", "trip", "rank", "station_id", "station"]
    ordered = pieces.repartition(partitions, *document).sortWithinPartitions(*document, *order)
    written = ordered.select(
        "kind",
        *document,
        *_COUNTS,
        F.concat(F.lit("days/"), F.col("id"), _part_suffix()).alias("stem"),
        (F.col("section") == _HEAD).alias("begins"),
        F.col("section").isin(_TRIP, _STATION).alias("item"),
        F.coalesce("text", F.to_json("trip", _AS_WRITTEN), F.to_json("station", _AS_WRITTEN)).alias("text"),
    )
    return write_pieces(written, root, ["kind", *document], _COUNTS, HASH_DIGITS)


def shard_documents(routes: DataFrame, shards: DataFrame, provider: str) -> DataFrame:
    """One document per shard: its routes' coordinates by key, in packing order.

    A shard is bounded by the packing target. A key repeated inside a shard keeps
    its first place and its last coordinates.
    """
    placed = shards.select("place", "shard_id").join(routes.select("place", "route_key", "coordinates"), "place")
    spans = placed.groupBy("shard_id", "route_key").agg(F.min("place").alias("first"), F.max("place").alias("place"))
    kept = placed.join(spans, ["shard_id", "route_key", "place"])
    entries = F.array_sort(F.collect_list(F.struct("first", "route_key", "coordinates")))
    packed = kept.groupBy("shard_id").agg(entries.alias("entries"), F.count(F.lit(1)).alias("routes_in_shard"))
    routes_map = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["route_key"], e["coordinates"])))
    body = F.struct(F.lit(VERSION).alias("version"), F.lit(ENCODING).alias("encoding"), routes_map.alias("routes"))
    path = F.concat(F.lit(f"routes/{provider}-cycling-v1/"), F.col("shard_id"))
    return _documents(
        packed.withColumn("part", F.lit(0)),
        "shard",
        F.col("shard_id"),
        path,
        F.to_json(body, _AS_WRITTEN),
        "routes_in_shard",
    )


def station_master_document(stations: DataFrame, limit: int = PAGE_STATIONS) -> DataFrame:
    """The station master, sorted by id, in pages of ``limit`` stations."""
    record = F.struct(
        F.col("bikepoint_id").alias("bikepointId"),
        F.col("bikepoint_number").alias("bikepointNumber"),
        F.col("common_name").alias("name"),
        F.col("terminal_name").alias("terminalName"),
        F.array("lon", "lat").alias("coord"),
        "installed",
        "locked",
        "temporary",
        F.col("nb_docks").alias("nbDocks"),
    )
    placed = numbered(
        stations.select("bikepoint_id", "ordinal", record.alias("record")),
        [F.asc("bikepoint_id"), F.asc("ordinal")],
        "place",
    )
    parts = placed.groupBy(F.floor(F.col("place") / limit).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "record"))).alias("rows"),
        F.count(F.lit(1)).alias("stations_in_document"),
    )
    listed = F.transform("rows", lambda row: row["record"])
    body = F.struct(F.lit(VERSION).alias("version"), listed.alias("stations"))
    path = F.concat(F.lit(STATIONS_PATH), _part_suffix())
    return _documents(
        parts, "stations", F.lit("stations"), path, F.to_json(body, _AS_WRITTEN), "stations_in_document"
    )


def write_documents(documents: DataFrame, root: str) -> DataFrame:
    """Write each document, and a gzip copy, at its ``path`` below ``root``; returns the rows with ``gzip_bytes`` and no ``json``."""
    return write_files(documents, root, content="json")


def export_sizes(documents: DataFrame, root: str) -> DataFrame:
    """Documents with the sizes of their files as they lie below ``root``: ``file_bytes`` and ``gzip_bytes``, null if absent."""
    found = staged(listed(documents.sparkSession, root), "export-listing")
    plain = found.select("path", F.col("length").alias("file_bytes"))
    packed = found.select(F.regexp_extract("path", r"^(.*)\.gz$", 1).alias("path"), F.col("length").alias("gzip_bytes"))
    return documents.drop("json").join(plain, "path", "left").join(packed, "path", "left")


def manifest(
    trips: DataFrame,
    days: DataFrame,
    shards: DataFrame,
    stations: DataFrame,
    provider: str,
    target_gzip_bytes: int = SHARD_GZIP_BYTES,
    compression_ratio: float = SHARD_COMPRESSION,
) -> DataFrame:
    """The one-row manifest over ``export_sizes`` rows of day, shard and station documents.

    It lists documents, not rows: an entry per day with its slices, per shard and per
    station page. A day's own file is its first slice, and its counts add up all slices.
    """

    def entries(df: DataFrame, order: list[str], **fields: Column | str) -> Column:
        record = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])
        rows = F.array_sort(F.collect_list(F.struct(*order, record.alias("record"))))
        return F.transform(rows, lambda row: row["record"])

    files = dict(path="path", gzipPath=F.concat("path", F.lit(".gz")), hash="hash", bytes="bytes", gzipBytes="gzip_bytes")
    sliced = days.groupBy("id").agg(
        entries(days, ["part"], slice="part", trips="trips_in_slice", routedTrips="routed_in_slice", **files).alias("slices"),
        F.sum("trips_in_slice").alias("trips_in_day"),
        F.sum("routed_in_slice").alias("routed_in_day"),
    )
    own = {name: F.col("slices")[0][name] for name in files}
    day_rows = sliced.agg(
        entries(sliced, ["id"], date="id", trips="trips_in_day", routedTrips="routed_in_day", **own, slices="slices").alias("days")
    )
    shard_rows = shards.agg(
        entries(shards, ["id"], id="id", routeCount="routes_in_shard", **files).alias("shards"),
        F.count(F.lit(1)).alias("shard_count"),
        F.coalesce(F.sum("routes_in_shard"), F.lit(0)).alias("route_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("shard_bytes"),
        F.coalesce(F.sum("gzip_bytes"), F.lit(0)).alias("shard_gzip_bytes"),
    )
    station_rows = stations.agg(
        entries(stations, ["part"], stationCount="stations_in_document", **files).alias("station_files"),
        F.sum("stations_in_document").alias("station_count"),
    )
    def packed(row: DataFrame) -> Column:
        return row.select(F.struct("*")).scalar()

    joined = date_range(trips).select(
        "*", packed(day_rows).alias("d"), packed(shard_rows).alias("s"), packed(station_rows).alias("m")
    ).select("min_date", "max_date", "trip_count", "d.*", "s.*", "m.*")
    folder = f"routes/{provider}-cycling-v1"
    routes = F.struct(
        F.lit(provider).alias("provider"),
        F.lit(f"{provider}-cycling-v1").alias("version"),
        F.lit(ENCODING).alias("encoding"),
        F.lit(SHARD_STRATEGY).alias("shardStrategy"),
        F.lit(folder + "/{shard}.json").alias("shardTemplate"),
        F.lit(folder + "/{shard}.json.gz").alias("gzipShardTemplate"),
        F.lit(target_gzip_bytes).alias("shardTargetGzipBytes"),
        F.lit(float(compression_ratio)).alias("estimatedCompressionRatio"),
        F.col("shard_count").alias("shardCount"),
        F.col("route_count").alias("routeCount"),
        F.col("shard_bytes").alias("bytes"),
        F.col("shard_gzip_bytes").alias("gzipBytes"),
        "shards",
    )
    station_file = F.struct(
        *[F.col("station_files")[0][name].alias(name) for name in ("path", "gzipPath", "hash", "bytes", "gzipBytes")],
        F.col("station_count").alias("stationCount"),
        F.col("station_files").alias("files"),
    )
    return joined.select(
        F.lit(VERSION).alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generatedAt"),
        F.struct(
            F.col("min_date").alias("minDate"), F.col("max_date").alias("maxDate"), F.col("trip_count").alias("tripCount")
        ).alias("dateRange"),
        F.struct(routes.alias("routes"), station_file.alias("bikepoints")).alias("files"),
        "days",
    )


def write_manifest(manifest_row: DataFrame, root: str) -> None:
    """Replace ``root/manifest.json`` and its gzip copy."""
    text = manifest_row.select(F.lit(MANIFEST).alias("path"), F.to_json(F.struct("*"), _AS_WRITTEN).alias("json"))
    write_files(text, root, content="json", replace=True)


def select_routes(google: DataFrame, mapbox: DataFrame, provider: str) -> DataFrame:
    """Routes of one provider in cache order, or of both with the second overriding."""
    if provider == "all":
        return merge_providers(google, mapbox)
    return single_provider({"google": google, "mapbox": mapbox}[provider])


def provider_routes(spark: SparkSession, root: str, provider: str) -> DataFrame:
    """Routes in the caches of a data folder; a provider without a cache has none."""

    def cached(name: str) -> DataFrame:
        path = f"{root}/{TABLE_VIEWS[name + '_routes']}"
        if has_files(spark, path):
            return load_routes(spark.read.parquet(path))
        return load_routes(spark.createDataFrame([], nullable(ROUTE_CACHE).add("ordinal", T.LongType())))

    if provider not in ("all", "google", "mapbox"):
        raise ValueError(f"unknown route provider: {provider}")
    return select_routes(cached("google"), cached("mapbox"), provider)


# -- what an export can leave as it is ----------------------------------------


def _digest(*columns: Column | str) -> Column:
    """A digest of a table's rows in any order, repeated ones told apart: their number, a sum and exclusive ors."""
    row = F.xxhash64(*columns)
    low = F.sum(F.pmod(row, F.lit(1 << 31)))
    return F.concat_ws("-", F.count(F.lit(1)), low, F.bit_xor(row), F.bit_xor(F.xxhash64(row, F.lit(1))))


def day_inputs(
    trips: DataFrame, days: DataFrame, stations: DataFrame, routes: DataFrame, shards: DataFrame, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """``day`` and ``input``: a digest of all that the documents of a day are made of."""
    of_day = trips.groupBy(F.to_date("start_at").alias("day")).agg(_digest(*trips.columns).alias("own"))

    def whole(table: DataFrame) -> Column:
        return table.agg(_digest(F.to_json(F.struct(*table.columns)))).scalar()

    parts = [F.coalesce("own", F.lit("")), whole(stations), whole(routes), whole(shards.select("route_key", "shard_id"))]
    text = F.concat_ws("|", *parts, F.lit(f"{VERSION} {slice_seconds}"))
    return days.join(of_day, "day", "left").select("day", F.sha2(text, 256).alias("input"))


def export(
    trips: DataFrame,
    stations: DataFrame,
    routes: DataFrame,
    provider: str,
    root: str,
    days: Iterable[date] = (),
    limit_days: int | None = None,
    target_gzip_bytes: int = SHARD_GZIP_BYTES,
    compression_ratio: float = SHARD_COMPRESSION,
    slice_seconds: int = SLICE_SECONDS,
    previous: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write every document and the manifest; returns the manifest row and the entries of all documents.

    All days are exported by one job: located and routed trips are written once, and
    every document reads from that table. Entries are documents without their text, with
    ``input`` (what a day is made of) and ``written`` (whether its files are of this run).
    With the entries of an export before (``previous``), days with the same input and
    documents with the same path are left as they are, if their files lie in ``root``.
    """
    spark = trips.sparkSession
    chosen = staged(select_days(trips, days, limit_days), "days")
    shards = staged(pack_shards(routes, target_gzip_bytes, compression_ratio), "shards")
    inputs = staged(day_inputs(trips, chosen, stations, routes, shards, slice_seconds), "day-inputs")
    if previous is None:
        previous = spark.createDataFrame([], EXPORT_ENTRY)
    there = export_sizes(previous.drop("gzip_bytes"), root)
    there = staged(there.filter((F.col("file_bytes") == F.col("bytes")) & F.col("gzip_bytes").isNotNull()), "entries-there")

    # A day is left alone if all its slices are there: none is listed whose file has gone.
    slices = previous.filter("kind = 'day'").groupBy("id", "input").agg(F.count("*").alias("slices"))
    present = there.filter("kind = 'day'").groupBy("id", "input").agg(F.count("*").alias("slices"))
    same = inputs.select(F.col("day").cast("string").alias("id"), "input")
    same = staged(same.join(slices, ["id", "input"]).join(present, ["id", "input", "slices"], "left_semi"), "days-there")
    stale = chosen.join(same.select(F.to_date("id").alias("day")), "day", "left_anti")
    stale = staged(stale, "days-stale")

    playback = playback_trips(trips).join(stale, "day", "left_semi")
    routed = staged(route_join(locate_trips(playback, stations), route_lookup(routes, shards)), "routed")
    matches = staged(station_matches(routed, stations, F.col("day")), "day-stations")
    summary = day_summary(routed, routed, stations, stale, matches)
    records = station_records(matches, "day")
    pieces = day_documents(replay_trips(routed), records, activity_bins(routed, stale), summary, slice_seconds)
    made = write_days(pieces, root).join(inputs.select(F.col("day").cast("string").alias("id"), "input"), "id")
    sizes = there.select("path", "gzip_bytes").distinct()
    made = made.join(sizes.select("path", F.lit(False).alias("written")), "path", "left")
    made = made.withColumn("written", F.coalesce("written", F.lit(True)))

    others = shard_documents(routes, shards, provider).unionByName(station_master_document(stations), allowMissingColumns=True)
    # Written once: documents carry whole JSON texts.
    others = staged(others, "documents")
    missing = others.join(sizes, "path", "left_anti")
    written = write_documents(missing, root).withColumn("written", F.lit(True))
    kept = others.drop("json").join(sizes, "path").withColumn("written", F.lit(False))
    left = there.join(same.select("id", "input"), ["id", "input"], "left_semi").withColumn("written", F.lit(False))

    def entry(table: DataFrame) -> DataFrame:
        named = [F.col(f.name) if f.name in table.columns else F.lit(None) for f in EXPORT_ENTRY]
        return table.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(named, EXPORT_ENTRY, strict=True)], "written")

    entries = staged(reduce(DataFrame.union, map(entry, (made, written, kept, left))), "entries")
    of = {kind: entries.filter(F.col("kind") == kind) for kind in ("day", "shard", "stations")}
    row = manifest(trips, of["day"], of["shard"], of["stations"], provider, target_gzip_bytes, compression_ratio)
    row = staged(row, "manifest-row")
    write_manifest(row, root)
    return row, entries


def run_export(
    spark: SparkSession,
    root: str,
    out: str,
    provider: str = "all",
    days: Iterable[date] = (),
    limit_days: int | None = None,
    target_gzip_bytes: int = SHARD_GZIP_BYTES,
    compression_ratio: float = SHARD_COMPRESSION,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Export the data folder ``root`` to ``out``: only what changed since its last export there is made and written.

    Validated trips, the station master and the providers' route caches are read below
    ``root``; a cache that is not there is empty. Entries of what was exported are kept
    below ``root/metadata``, one table per folder exported to. Returns the entries.
    """
    trips = scan_trips(spark, f"{root}/{TRIP_VIEWS['trips']}")
    stations = spark.read.parquet(f"{root}/{TABLE_VIEWS['bikepoints']}")
    routes = provider_routes(spark, root, provider)
    state = f"{root}/{EXPORTS}/{hashlib.sha256(qualified(spark, out).encode()).hexdigest()[:HASH_DIGITS]}"
    previous = read_version(spark, state, nullable(EXPORT_ENTRY)) if has_files(spark, f"{state}/{CURRENT}") else None
    settings = target_gzip_bytes, compression_ratio, slice_seconds
    _, entries = export(trips, stations, routes, provider, out, days, limit_days, *settings, previous=previous)
    write_version(entries.drop("written"), state)
    return entries


DAY_SCHEMA = (
    "date string, "
    "stations array<struct<id: string, stationId: string, name: string, bikepointId: string, "
    "coord: array<double>, tripCount: bigint, departureCount: bigint, arrivalCount: bigint, matchMethod: string>>, "
    "trips array<struct<id: string, bikeId: string, bikeModel: string, start: bigint, end: bigint, "
    "durationSeconds: bigint, fromStationId: string, fromStationName: string, toStationId: string, "
    "toStationName: string, fromCoord: array<double>, toCoord: array<double>, routeKey: string, "
    "routeShard: string, routeDistanceMeters: double, routeReversed: boolean>>, "
    "activity array<struct<time: int, activeTrips: bigint>>, "
    "summary struct<totalTrips: bigint, matchedTrips: bigint, unmatchedTrips: bigint, stationCount: bigint, "
    "routedTrips: bigint>"
)


def _entries(spark: SparkSession, root: str, column: str, schema: str) -> DataFrame:
    """The manifest's list of entries ``column``, of which ``schema`` names the fields; a row per slice of a day."""
    listing = spark.read.schema(_nested(column, f"array<struct<{schema}>>")).json(f"{root}/{MANIFEST}")
    entries = listing.select(F.explode(column).alias("e")).select("e.*")
    if "slices" in entries.columns:
        entries = entries.select(F.col("date").alias("id"), F.explode("slices").alias("s"))
        entries = entries.select("id", F.col("s.slice").alias("part"), "s.path", "s.bytes")
    return entries


def _listed_documents(spark: SparkSession, root: str, column: str, entries: DataFrame, glob: str = "*") -> DataFrame:
    """Texts of the documents that the manifest lists now (``entries``); files of earlier exports stay beside them."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = {"days": "days", "files.routes.shards": "routes"}[column]
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{glob}.json")
    texts = texts.option("wholetext", "true").text(f"{root}/{folder}")
    texts = texts.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("json"))
    return entries.withColumn("name", name).join(texts, "name").drop("name", "path", "bytes")


def _nested(column: str, kind: str) -> str:
    """A schema with one column at a place such as ``a.b.c``."""
    first, *inner = column.split(".")
    for name in reversed(inner):
        kind = f"struct<{name}: {kind}>"
    return f"{first} {kind}"


def load_day(spark: SparkSession, root: str, day: date | None = None, characters: int | None = None) -> DataFrame:
    """Exported day documents read back, one row per slice; of one day when it is given.

    A row holds its slice. With ``characters`` a slice is a row per stretch of so many
    characters of its stations and trips, numbered by ``stretch``, so that no row grows
    with the day: all have the date, the last one has activity and summary.
    """
    schema = "date: string, slices: array<struct<slice: int, path: string, bytes: bigint>>"
    entries, keys = _entries(spark, root, "days", schema), ["id", "part"]
    if characters is None:
        glob = "*" if day is None else f"{day.isoformat()}*"
        texts = _listed_documents(spark, root, "days", entries, glob)
    else:
        wanted = entries if day is None else entries.filter(F.col("id") == day.isoformat())
        texts = read_stretches(staged(wanted, "day-entries"), root, ["stations", "trips"], characters)
        keys.append("stretch")
    return texts.select(*keys, F.from_json("json", DAY_SCHEMA).alias("d")).select(*keys, "d.*")


def load_shard(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Coordinates of the ``wanted`` (shard_id, route_key) rows from exported shards."""
    schema = "routes map<string, array<array<double>>>"
    column = "files.routes.shards"
    shards = _listed_documents(spark, root, column, _entries(spark, root, column, "id: string, path: string"))
    shards = shards.withColumnRenamed("id", "shard_id")
    needed = wanted.select("shard_id").distinct()
    entries = shards.join(needed, "shard_id", "left_semi").select(
        "shard_id", F.explode(F.from_json("json", schema)["routes"]).alias("route_key", "coordinates")
    )
    return entries.join(wanted.select("shard_id", "route_key").distinct(), ["shard_id", "route_key"], "left_semi")
