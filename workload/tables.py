"""The driver's tables read as journey data (Spark side; ``duck.py`` says the same in SQL).

The base tables are written once per session to the shared folder, in the form
the ingest job leaves them, and every query reads them from there. Trips come from ``events``, stations from ``supplier``, route caches from
``supplier`` with the pairs its trips ride, the listing and ledger from ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velospan.functions.text import name_key, numeric_key
from velospan.operators.replay import locate_trips, playback_trips, replay_trips
from velospan.operators.routes import load_routes, merge_providers, route_join, route_lookup
from velospan.schemas import LAYOUTS, LEDGER_COLUMNS, TRIP_COLUMNS
from velospan.plans.days import has_ranges, refresh_ranges
from velospan.sources.trips import scan_trips, write_by_source
from velospan.staging import fresh_path

CLOCKS = [0, 21600, 30600, 43200, 61200, 79200, 86399]
SHARD_TARGET = (1000, 4.0)

_text = "string"


def _name(k: str, first: str = "'Dock '") -> str:
    return f"concat({first}, {k} - ({k} % 10) div 9, ', Area ', {k} % 20)"


def _named(k: str, e: str) -> str:
    shouted, spoken = _name(k, "'DOCK '").replace("Area", "AREA"), _name(k)
    return f"if({e} % 5 = 0, {shouted}, {spoken})"


def _station_id(k: str, e: str) -> str:
    return f"if({e} % 4 = 3, 'T', concat(if({e} % 4 = 1, '00', ''), {k} + if({e} % 4 = 2, 2000000, 0)))"


_WRITTEN: dict[tuple[str, str, str], str] = {}


class Tables:
    """Lazily built tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str, write: Callable[[str], None]) -> str:
        """A folder written by the first query of the session that needs it."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = fresh_path(self.spark, name)
            write(path)
            _WRITTEN[key] = path
        return _WRITTEN[key]

    def _written(self, name: str, build: Callable[[], DataFrame], by_source: bool = False) -> str:
        if by_source:
            return self.once(name, lambda path: write_by_source(build(), path))
        return self.once(name, lambda path: build().write.parquet(path))

    @cached_property
    def trips_folder(self) -> str:
        path = self._written("trips", self._trips, by_source=True)
        if not has_ranges(self.spark, path):
            refresh_ranges(self.spark, path)
        return path

    @cached_property
    def trips(self) -> DataFrame:
        return scan_trips(self.spark, self._written("trips", self._trips, by_source=True))

    @cached_property
    def stations(self) -> DataFrame:
        return self.spark.read.parquet(self._written("stations", self._stations))

    def _trips(self) -> DataFrame:
        events = self.read("events").selectExpr(
            "event_id AS e",
            "user_id AS u",
            "event_type",
            "ts",
            "cast(floor(value * 240) AS bigint) AS seconds",
            "if(event_id % 9 = 0, user_id, user_id div 2 + event_id % 11) AS g",
        )
        values = {
            "journey_id": "cast(e AS string)",
            "bike_id": "cast(u AS string)",
            "bike_model": "event_type",
            "start_at": "ts",
            "end_at": "ts + make_dt_interval(0, 0, 0, cast(seconds AS decimal(18, 6)))",
            "start_station_id": _station_id("u", "e"),
            "start_station_name": _named("u", "e"),
            "end_station_id": f"if(e % 10 = 7, NULL, {_station_id('g', '(e + 1)')})",
            "end_station_name": f"if(e % 97 = 0, NULL, {_named('g', '(e + 1)')})",
            "duration_seconds": "seconds",
            "duration_ms": "seconds * 1000",
            "source_key": "concat(cast(date(ts) AS string), '.csv')",
            "source_etag": "concat('etag-', cast(date(ts) AS string))",
            "source_member": "cast(NULL AS string)",
            "source_row_number": "e + 1",
        }
        return events.selectExpr(*[f"{values[name]} AS {name}" for name in TRIP_COLUMNS])

    def _stations(self) -> DataFrame:
        station = self.read("supplier").selectExpr(
            "s_suppkey AS k",
            "s_nationkey",
            "if(s_suppkey % 7 = 0, NULL, cast(s_suppkey + 2000000 AS string)) AS terminal",
            f"{_name('s_suppkey')} AS name",
        )
        columns = station.selectExpr(
            "k AS ordinal",
            "concat('BikePoints_', k) AS bikepoint_id",
            "cast(k AS string) AS bikepoint_number",
            "terminal AS terminal_name",
            "name AS common_name",
            "if(k % 23 = 5, NULL, 51.5D + k / 1000) AS lat",
            "k / 1000 - 3.0D AS lon",
            "k % 2 = 0 AS installed",
            "k % 3 = 0 AS locked",
            "false AS temporary",
            "cast(s_nationkey AS bigint) AS nb_docks",
        )
        return columns.select(
            "*",
            numeric_key("bikepoint_number").alias("bikepoint_number_key"),
            numeric_key("terminal_name").alias("terminal_name_key"),
            name_key("common_name").alias("common_name_key"),
        )

    @cached_property
    def route_pairs(self) -> DataFrame:
        """Pairs of different stations that trips ride, with repeats, and their place in a cache."""
        pairs = self.read("supplier").selectExpr("s_suppkey AS k", "explode(sequence(0L, 10L)) AS j")
        apart = pairs.selectExpr(
            "k", "j", "k div 2 + j AS far", "concat('BikePoints_', k) AS own", "concat('BikePoints_', k div 2 + j) AS other"
        ).filter("k <> far")
        return apart.selectExpr(
            "k",
            "j",
            "k * 11 + j AS ordinal",
            "least(own, other) AS pair_from",
            "greatest(own, other) AS pair_to",
            "if(own < other, k, far) AS a",
            "if(own < other, far, k) AS b",
        )

    def _cache(self, every: int) -> DataFrame:
        step = "(b - a) / 1000 * i / (2 + k % 4)"
        point = f"concat('[', round(a / 1000 - 3.0D + {step}, 6), ',', round(51.5D + a / 1000 + {step}, 6), ']')"
        line = f"if(k % 17 = 3, '', array_join(transform(sequence(0L, 2 + k % 4), i -> {point}), ','))"
        failed = "k % 13 = 5"
        return self.route_pairs.filter(f"(k + j) % {every} = 0").selectExpr(
            "ordinal",
            "pair_from",
            "pair_to",
            f"""if({failed}, 'null', concat('{{"type":"LineString","coordinates":[', {line}, ']}}')) AS geometry""",
            f"""if({failed}, '{{"type":"FetchError"}}', 'null') AS error""",
            f"if(k % 5 = 0, NULL, k + {every}) AS trip_count",
            f"abs(a - b) * 100.0D + j * 7.5D + {every} AS distance_meters",
        )

    @cached_property
    def cache_a(self) -> DataFrame:
        return self.spark.read.parquet(self._written("cache-a", lambda: self._cache(2)))

    @cached_property
    def cache_b(self) -> DataFrame:
        return self.spark.read.parquet(self._written("cache-b", lambda: self._cache(3)))

    @cached_property
    def routes(self) -> DataFrame:
        return merge_providers(load_routes(self.cache_a), load_routes(self.cache_b))

    @cached_property
    def playback(self) -> DataFrame:
        return playback_trips(self.trips)

    @cached_property
    def located(self) -> DataFrame:
        return locate_trips(self.playback, self.stations)

    @cached_property
    def routed(self) -> DataFrame:
        return route_join(self.located, route_lookup(self.routes))

    @cached_property
    def replay(self) -> DataFrame:
        return replay_trips(self.routed)

    @cached_property
    def raw_columns(self) -> DataFrame:
        """Trip text as a landed file would hold it, with the layout it is written in."""

        def stamp(at: str) -> str:
            shape = (
                "if(layout_number = 4, "
                "if(e % 3 = 0, ' yyyy-MM-dd HH:mm  ', if(e % 3 = 1, 'dd/MM/yyyy HH:mm', 'dd/MM/yyyy HH:mm:ss')), "
                "if(e % 3 = 0, 'dd/MM/yyyy HH:mm', if(e % 3 = 1, 'dd/MM/yyyy HH:mm:ss', 'yyyy-MM-dd HH:mm:ss')))"
            )
            return f"if(e % 71 = 0, 'n/a', date_format({at}, {shape})) AS {at}"

        numbered = self.trips.selectExpr(
            "*", "source_row_number - 1 AS e", "(source_row_number - 1) % 5 AS layout_number"
        )
        return numbered.selectExpr(
            "e AS event_id",
            "layout_number",
            "concat('  ', journey_id, '\t') AS journey_id",
            "bike_id",
            "bike_model",
            stamp("start_at"),
            stamp("end_at"),
            "start_station_id",
            "concat(start_station_name, ' ') AS start_station_name",
            "end_station_id",
            "end_station_name",
            "if(e % 13 = 0, NULL, if(e % 17 = 0, '12.5', cast(if(layout_number = 4, duration_ms, duration_seconds) AS string))) AS duration",
            "source_key",
            "source_etag",
            "source_row_number",
        )

    @cached_property
    def raw_rows(self) -> DataFrame:
        """The same as positional rows of each layout, one extra column behind them."""

        def of_layout(pick) -> Column:
            chain = F.when(F.col("layout_number") == 0, pick(LAYOUTS[0]))
            for number, layout in enumerate(LAYOUTS[1:], 1):
                chain = chain.when(F.col("layout_number") == number, pick(layout))
            return chain

        return self.raw_columns.select(
            of_layout(lambda l: F.lit([*l.required, "Extra"])).alias("header"),
            of_layout(lambda l: F.array(*l.headers, F.lit("x"))).alias("fields"),
            "source_key",
            "source_etag",
            F.lit(None).cast(_text).alias("source_member"),
            "source_row_number",
        )

    @cached_property
    def dirty(self) -> DataFrame:
        """Trips with faults: no bike, swapped times, a wrong duration, a repeated id, no name, two weeks and more,
        a row number of 0, a duration in letters (that column is text)."""
        event = F.col("journey_id").cast("bigint")
        long_ms = F.lit(15 * 86_400_000).cast("bigint")
        late = event % 71 == 0
        changed = {
            "bike_id": F.when(event % 50 != 0, F.col("bike_id")),
            "start_at": F.when(event % 53 == 0, F.col("end_at")).otherwise(F.col("start_at")),
            "end_at": F.when(event % 53 == 0, F.col("start_at"))
            .when(late, F.col("start_at") + F.expr("INTERVAL 15 DAY"))
            .otherwise(F.col("end_at")),
            "duration_seconds": F.when(event % 59 == 0, F.col("duration_seconds") + 300)
            .when(late, F.lit(15 * 86_400).cast("bigint"))
            .otherwise(F.col("duration_seconds")),
            "duration_ms": F.when(event % 83 == 0, "n/a").otherwise(F.when(late, long_ms).otherwise(F.col("duration_ms")).cast(_text)),
            "source_row_number": F.when(event % 79 == 0, F.lit(0).cast("bigint")).otherwise(F.col("source_row_number")),
            "journey_id": F.when(event % 61 == 0, "repeated").otherwise(F.col("journey_id")),
            "start_station_name": F.when(event % 67 == 0, "").otherwise(F.col("start_station_name")),
        }
        return self.trips.select(*[changed.get(c, F.col(c)).alias(c) for c in TRIP_COLUMNS])

    @cached_property
    def listing(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.read("orders").select(
            F.concat(F.lit("files/"), key.cast(_text), F.lit(".csv")).alias("source_key"),
            F.when(key % 97 == 0, 0).otherwise(F.floor("o_totalprice")).cast("bigint").alias("size_bytes"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified"),
            F.col("o_orderpriority").alias("etag"),
            key.alias("position"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Orders not divisible by five, some with an old size or no etag, in mixed states; and gone files."""
        key = F.col("o_orderkey")
        done = key % 4 != 0
        normalized = F.when(key % 4 == 1, "normalized").when(key % 4 == 2, "failed").when(key % 8 == 3, "skipped")
        validated = F.when(key % 8 == 1, "validated").when(key % 16 == 5, "failed")
        gone = F.when(key % 101 == 0, "gone/").otherwise("files/")
        source = F.concat(gone, key.cast(_text), F.lit(".csv"))
        rows = F.when(key % 4 == 1, key % 1000)
        values = {
            "source_key": source,
            "source_url": F.concat(F.lit("u/"), source),
            "etag": F.when(key % 11 != 0, F.col("o_orderpriority")),
            "size_bytes": F.floor("o_totalprice") + F.when(key % 7 == 0, 1).otherwise(0),
            "last_modified": F.date_format("o_orderdate", "yyyy-MM-dd"),
            "raw_path": F.concat(F.lit("raw/"), source),
            "normalized_path": F.when(key % 4 == 1, F.concat(F.lit("n/"), source)),
            "raw_status": F.when(done, "downloaded").otherwise("failed"),
            "normalized_status": F.coalesce(normalized, F.lit("pending")),
            "validated_status": F.coalesce(validated, F.lit("pending")),
            "row_count_raw": rows,
            "row_count_normalized": rows,
            "schema_version": F.when(key % 4 == 1, "trips_v1"),
            "error_message": F.when(key % 4 == 2, "bad"),
            "discovered_at": F.lit("2024-01-01 00:00:00"),
        }
        columns = [values.get(c, F.lit(None).cast(_text)).alias(c) for c in LEDGER_COLUMNS]
        ledger = self.read("orders").filter(key % 5 != 0).select(*columns)
        counts = ["size_bytes", "row_count_raw", "row_count_normalized", "row_count_validated", "row_count_invalid"]
        return ledger.withColumns({c: F.col(c).cast("bigint") for c in counts})
