"""The ingest job: landed files -> ledger -> normalized trips -> validated trips -> stations.

Every stage is one set of Spark jobs over all files the ledger plans for it. The
driver sees file names and header widths, never rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.operators.normalize import detect_layout, normalize_trips, unknown_layout_message
from velospan.operators.stations import sample_station_matches
from velospan.operators.validate import check_trips, rejected_trips, repeated_keys, valid_trips
from velospan.plans import ledger as L
from velospan.plans.catalog import TABLE_VIEWS, TRIP_VIEWS
from velospan.plans.days import refresh_ranges
from velospan.schemas import TRIP, nullable
from velospan.sources.files import has_files
from velospan.sources.listing import read_listing
from velospan.sources.station_master import flatten_stations, read_station_master
from velospan.sources.trip_files import (
    csv_fingerprints,
    csv_headers,
    read_trip_csv,
    read_zip_members,
    scan_csv,
    unique_members,
    zip_directory,
)
from velospan.sources.trips import SOURCE_PART, source_part, write_by_source
from velospan.staging import staged

# Folders of the data root.
RAW = "raw"
LEDGER = "metadata/files"
FINGERPRINTS = "metadata/fingerprints"
NORMALIZED = TRIP_VIEWS["normalized_trips"]
VALIDATED = TRIP_VIEWS["trips"]
REJECTED = "validation/invalid"


def _key_of(path: Column, encoded: bool, root: str) -> Column:
    """Source key of a landed file: its path below the raw folder of ``root``, which may lie in another one."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    folder = re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", root).rstrip("/")
    return F.regexp_extract(plain, rf"^.*?\Q{folder}/{RAW}/\E(.*)$", 1)


def current_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The ledger as last written; empty before the first run."""
    if not has_files(spark, f"{root}/{LEDGER}/current"):
        return L.empty_ledger(spark)
    return L.read_ledger(spark, f"{root}/{LEDGER}")


def landed_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(source_key, landed_bytes) of every raw file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{RAW}")
    return files.select(_key_of(F.col("path"), False, root).alias("source_key"), F.col("length").alias("landed_bytes"))


def run_raw(
    spark: SparkSession,
    root: str,
    pages: str | list[str],
    prefix: str = "",
    include_empty: bool = False,
    limit: int | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Plan files from landed listing pages and record which of them have landed whole."""
    listing = read_listing(spark, pages, prefix, include_empty)
    updated, plan = L.plan_raw(listing, current_ledger(spark, root), ["page", "position"], limit)
    updated = staged(updated, "ledger")
    if not dry_run:
        updated = L.apply_outcomes(updated, L.check_downloads(plan, landed_sizes(spark, root)), "raw")
    L.write_ledger(updated, f"{root}/{LEDGER}")
    return plan


def _paths(spark: SparkSession, root: str, plan: DataFrame, suffix: str) -> list[str]:
    """Paths of planned files of one kind: a list of names, as any Spark reader takes.

    Readers take names as patterns, so characters of patterns are escaped.
    """
    chosen = plan.filter(F.lower("source_key").endswith(suffix)).select("source_key")
    return [f"{root}/{RAW}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", row.source_key) for row in chosen.toLocalIterator()]


def _flat_files(spark: SparkSession, root: str, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, one row per unusable file with its error) of flat CSV files."""
    scan = scan_csv(spark, paths)
    heads = csv_headers(scan.profile)
    key = _key_of(F.col("file"), True, root).alias("source_key")
    problem = F.when(F.col("bad_bytes"), F.lit("File is not valid UTF-8")).when(
        detect_layout(F.col("header")).isNull(), unknown_layout_message(F.col("header"))
    )
    found = heads.select(key, problem.alias("error"))
    rows = read_trip_csv(spark, paths, scan).withColumn("source_key", _key_of(F.col("file"), True, root))
    return rows, found


def _fingerprints(spark: SparkSession, root: str, directory: DataFrame, known: DataFrame) -> DataFrame:
    """(file_size, crc32) of landed flat files that are as long as a member of an archive.

    A file is hashed once: its checksum is kept beside the ledger with its size and time.
    """
    table, columns = f"{root}/{FINGERPRINTS}", "source_key string, file_size bigint, modified timestamp, crc32 bigint"
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{RAW}")
    key = _key_of(F.col("path"), False, root).alias("source_key")
    listing = listing.select(key, F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    listing = listing.join(known.filter(F.lower("source_key").endswith(".csv")), "source_key", "left_semi")
    wanted = staged(listing.join(directory.select("file_size").distinct(), "file_size", "left_semi"), "same-length")
    kept = spark.read.schema(columns).parquet(table) if has_files(spark, table) else spark.createDataFrame([], columns)
    same = ["source_key", "file_size", "modified"]
    paths = _paths(spark, root, wanted.join(kept, same, "left_anti"), ".csv")
    if paths:
        found = csv_fingerprints(spark, paths).select(_key_of(F.col("file"), True, root).alias("source_key"), "crc32")
        wanted.join(found, "source_key").select(*same, "crc32").write.mode("append").parquet(table)
        kept = spark.read.schema(columns).parquet(table)
    return kept.join(wanted, same, "left_semi").select("file_size", "crc32")


def _archives(spark: SparkSession, root: str, paths: list[str], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, one row per archive with its error and whether a member was left) of ZIP archives."""
    directory = staged(zip_directory(spark, paths), "zip-directory")
    members = unique_members(directory, _fingerprints(spark, root, directory, known))
    members = staged(members.select("file", "source_member"), "unique-members")
    rows = read_zip_members(spark, paths, members)
    unknown = F.when(
        F.col("error").isNull() & F.col("header").isNotNull() & detect_layout(F.col("header")).isNull(),
        unknown_layout_message(F.col("header")),
    )
    problems = rows.groupBy("file").agg(F.max(F.coalesce("error", unknown)).alias("row_error"))
    broken = directory.groupBy("file").agg(F.max("error").alias("archive_error"))
    left = members.groupBy("file").agg(F.count(F.lit(1)).alias("members"))
    found = (
        broken.join(problems, "file", "left")
        .join(left, "file", "left")
        .select(
            _key_of(F.col("file"), False, root).alias("source_key"),
            F.coalesce("archive_error", "row_error").alias("error"),
            F.coalesce("members", F.lit(0)).alias("members"),
        )
    )
    return rows.withColumn("source_key", _key_of(F.col("file"), False, root)), found


def run_normalize(
    spark: SparkSession, root: str, retry_failed: bool = False, force: bool = False, limit: int | None = None
) -> DataFrame:
    """Normalize the planned files; returns the outcomes. A bad file fails alone."""
    ledger = current_ledger(spark, root)
    plan = staged(L.plan_normalize(ledger, retry_failed, force, limit).select("source_key", "etag"), "normalize-plan")
    # A file that has gone since it was recorded fails alone: only what is there is opened.
    landed = staged(landed_sizes(spark, root).select("source_key").distinct(), "landed-keys")
    there = plan.join(landed, "source_key", "left_semi")
    csv_paths, zip_paths = _paths(spark, root, there, ".csv"), _paths(spark, root, there, ".zip")

    states = [
        spark.createDataFrame([], "source_key string, error string, members bigint"),
    ]
    rows = []
    columns = ["source_key", "source_member", "source_row_number", "header", "fields"]
    if csv_paths:
        flat, found = _flat_files(spark, root, csv_paths)
        rows.append(flat.select(*columns))
        states.append(found.withColumn("members", F.lit(1).cast("bigint")))
    if zip_paths:
        packed, found = _archives(spark, root, zip_paths, L.downloaded_files(ledger).select("source_key"))
        rows.append(packed.filter(F.col("error").isNull()).select(*columns))
        states.append(found)
    state = states[0]
    for more in states[1:]:
        state = state.unionByName(more)

    readable = F.lower("source_key").rlike(r"\.(csv|zip)$")
    unsupported = F.concat(
        F.lit("cannot read files of the type "), F.regexp_extract("source_key", r"(\.[^./]*)$", 1)
    )
    judged = staged(
        plan.join(state.withColumn("_seen", F.lit(True)), "source_key", "left")
        .join(landed.withColumn("_landed", F.lit(True)), "source_key", "left")
        .select(
            "source_key",
            "etag",
            F.when(~readable, unsupported)
            .when(F.col("_landed").isNull(), F.concat(F.lit("no landed file for "), "source_key"))
            .when(F.col("_seen").isNull(), F.lit("File has no rows to read"))
            .otherwise(F.col("error"))
            .alias("error"),
            F.coalesce("members", F.lit(0)).alias("members"),
        ),
        "normalize-state",
    )
    usable = judged.filter(F.col("error").isNull() & (F.col("members") > 0)).select(
        "source_key", F.col("etag").alias("source_etag")
    )
    if rows:
        whole = rows[0]
        for more in rows[1:]:
            whole = whole.unionByName(more)
        trips = normalize_trips(whole.join(usable, "source_key"))
        write_by_source(trips, f"{root}/{NORMALIZED}")

    counts = _parted(spark, f"{root}/{NORMALIZED}", usable) if rows else None
    counted = (
        usable.select("source_key", F.lit(0).cast("bigint").alias("rows"))
        if counts is None
        else counts.groupBy("source_key").agg(F.count(F.lit(1)).alias("rows"))
    )
    ok = F.col("error").isNull()
    outcomes = staged(
        judged.join(counted, "source_key", "left").select(
            "source_key",
            F.when(~ok, L.FAILED).when(F.col("members") == 0, L.SKIPPED).otherwise(L.NORMALIZED).alias("status"),
            F.when(~ok, F.col("error")).when(F.col("members") == 0, L.ALL_DUPLICATES).alias("error"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("rows", F.lit(0)).alias("raw_rows"),
            F.concat(F.lit(f"{NORMALIZED}/{SOURCE_PART}="), source_part("source_key")).alias("path"),
        ),
        "normalize-outcomes",
    )
    # Files that normalized to nothing must not keep rows of an earlier run.
    drop_sources(spark, f"{root}/{NORMALIZED}", outcomes.filter((F.col("status") == L.NORMALIZED) & (F.col("rows") == 0)))
    L.write_ledger(L.apply_outcomes(ledger, outcomes, "normalize"), f"{root}/{LEDGER}")
    return outcomes


def _parted(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Trips of the given sources; the join on the folder column prunes the other folders."""
    schema = T.StructType([*nullable(TRIP).fields, T.StructField(SOURCE_PART, T.StringType())])
    parts = keys.select(source_part("source_key").alias(SOURCE_PART))
    return spark.read.schema(schema).parquet(path).join(parts, SOURCE_PART, "left_semi").drop(SOURCE_PART)


def drop_sources(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Remove the folders of sources that have no rows any more; takes their names to the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in keys.select(source_part("source_key").alias("part")).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{SOURCE_PART}={row.part}")
        folder.getFileSystem(conf).delete(folder, True)


def run_validate(
    spark: SparkSession, root: str, retry_failed: bool = False, force: bool = False, limit: int | None = None
) -> DataFrame:
    """Split the planned files into valid and rejected trips; returns the outcomes."""
    ledger = current_ledger(spark, root)
    plan = staged(L.plan_validate(ledger, retry_failed, force, limit).select("source_key"), "validate-plan")
    if plan.isEmpty():
        return spark.createDataFrame([], "source_key string, status string, error string, valid_rows bigint, invalid_rows bigint")
    trips = _parted(spark, f"{root}/{NORMALIZED}", plan)
    keys = staged(repeated_keys(trips), "repeated-keys")
    # Counts, valid and rejected trips all read what was checked once.
    checked = staged(check_trips(trips, keys), "checked-trips")
    valid = F.size("failed_rules") == 0
    counts = checked.groupBy("source_key").agg(
        F.count_if(valid).alias("valid_rows"), F.count_if(~valid).alias("invalid_rows")
    )
    zero = F.lit(0).cast("bigint")
    counted = plan.join(counts, "source_key", "left").select(
        "source_key",
        F.coalesce("valid_rows", zero).alias("valid_rows"),
        F.coalesce("invalid_rows", zero).alias("invalid_rows"),
    )
    part = source_part("source_key")
    outcomes = staged(
        L.validation_outcome(counted).select(
            "*",
            F.concat(F.lit(f"{VALIDATED}/{SOURCE_PART}="), part).alias("valid_path"),
            F.when(F.col("invalid_rows") > 0, F.concat(F.lit(f"{REJECTED}/{SOURCE_PART}="), part)).alias("invalid_path"),
        ),
        "validate-outcomes",
    )
    write_by_source(valid_trips(checked), f"{root}/{VALIDATED}")
    write_by_source(rejected_trips(checked), f"{root}/{REJECTED}")
    drop_sources(spark, f"{root}/{VALIDATED}", outcomes.filter("valid_rows = 0"))
    drop_sources(spark, f"{root}/{REJECTED}", outcomes.filter("invalid_rows = 0"))
    refresh_ranges(spark, f"{root}/{VALIDATED}", outcomes.select(part.alias(SOURCE_PART)).distinct())
    L.write_ledger(L.apply_outcomes(ledger, outcomes, "validate"), f"{root}/{LEDGER}")
    return outcomes


def run_stations(spark: SparkSession, root: str, landed: str, sample_dates: Iterable[date]) -> DataFrame:
    """Flatten the landed station master and sample how trip stations match it; returns the samples."""
    stations_path, samples_path = TABLE_VIEWS["bikepoints"], TABLE_VIEWS["station_match_samples"]
    flatten_stations(read_station_master(spark, landed)).write.mode("overwrite").parquet(f"{root}/{stations_path}")
    stations = spark.read.parquet(f"{root}/{stations_path}")
    trips = spark.read.schema(nullable(TRIP)).parquet(f"{root}/{VALIDATED}")
    samples = sample_station_matches(trips, stations, sample_dates)
    samples.write.mode("overwrite").parquet(f"{root}/{samples_path}")
    return spark.read.parquet(f"{root}/{samples_path}")
