"""Every registered query, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velospan.functions.clock import playback_end, second_of_day
from velospan.functions.text import name_key, numeric_key, station_key
from velospan.operators import normalize, pairs, replay, routes, stations, timeline, validate
from velospan.plans import catalog, days, export, ledger
from velospan.schemas import LAYOUTS, TRIP_COLUMNS
from velospan.sources import listing, route_cache, station_master, trip_files, trips
from velospan.staging import fresh_path, staged
from workload import landing
from workload.duck import name_key as sql_name_key
from workload.duck import numeric_key as sql_numeric_key
from workload.duck import second, with_tables
from workload.tables import CLOCKS, SHARD_TARGET, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = date(2024, 1, 3)
DAYS = [date(2024, 1, 2), date(2024, 1, 15), date(2024, 1, 28)]
_DAYS_SQL = ", ".join(f"DATE '{d}'" for d in DAYS)
_CLOCKS_SQL = f"(SELECT unnest({CLOCKS}) AS clock)"
PAIR_LIMIT = 500
PLAN_LIMIT = 300


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with its SQL if there is one."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = with_tables(sql)
        return build

    return register


def _day(column: str = "day") -> Column:
    return F.col(column).cast("string").alias(column)


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _sharded_replay(t: Tables) -> DataFrame:
    """Replay trips that know the shard of their route."""
    packed = staged(routes.pack_shards(t.routes, *SHARD_TARGET), "packed")
    return replay.replay_trips(routes.route_join(t.located, routes.route_lookup(t.routes, packed)))


def _r(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column.split(".")[-1])


# -- trips, days, SQL ---------------------------------------------------------


@query("""SELECT cast(min(cast(start_at AS DATE)) AS VARCHAR) AS min_date, cast(max(cast(start_at AS DATE)) AS VARCHAR) AS max_date,
          count(*) AS trip_count FROM trips""")
def date_range(t: Tables) -> DataFrame:
    return replay.date_range(t.trips)


@query("SELECT DISTINCT cast(cast(start_at AS DATE) AS VARCHAR) AS day FROM trips ORDER BY day LIMIT 12")
def select_days(t: Tables) -> DataFrame:
    return replay.select_days(t.trips, limit=12).select(_day())


@query("""SELECT cast(cast(start_at AS DATE) AS VARCHAR) AS day, count(*) AS trips FROM trips
          WHERE start_at >= '2024-01-05' AND start_at < '2024-01-25' GROUP BY day""")
def trips_per_day(t: Tables) -> DataFrame:
    t.trips.createOrReplaceTempView("trips")
    days = catalog.run_sql(
        t.spark,
        """SELECT CAST(start_at AS DATE) AS day, COUNT(*) AS trips FROM trips
           WHERE start_at >= '2024-01-05' AND start_at < '2024-01-25' GROUP BY day ORDER BY trips DESC;""",
    )
    return days.select(_day(), "trips")


@query("""SELECT journey_id, cast(day AS VARCHAR) AS day, strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_at, end_station_id,
          duration_seconds FROM playback WHERE day = DATE '2024-01-03'""")
def day_filter(t: Tables) -> DataFrame:
    rows = replay.playback_trips(days.scan_days(t.spark, t.trips_folder, DAY), DAY)
    return rows.select("journey_id", _day(), _stamp("end_at"), "end_station_id", "duration_seconds")


# -- scalar functions ---------------------------------------------------------


@query(f"SELECT journey_id, {sql_numeric_key('start_station_id')} AS key FROM trips")
def numeric_keys(t: Tables) -> DataFrame:
    return t.trips.select("journey_id", numeric_key("start_station_id").alias("key"))


@query(f"SELECT journey_id, {sql_name_key('end_station_name')} AS key FROM trips")
def name_keys(t: Tables) -> DataFrame:
    return t.trips.select("journey_id", name_key("end_station_name").alias("key"))


@query("SELECT journey_id, coalesce(end_station_id, '') || chr(31) || coalesce(end_station_name, '') AS key FROM trips")
def station_keys(t: Tables) -> DataFrame:
    return t.trips.select("journey_id", station_key("end_station_id", "end_station_name").alias("key"))


@query(f"""SELECT journey_id, {second("start_at")} AS start_second,
           CASE WHEN {second("end_at")} < {second("start_at")} THEN {second("start_at")} + duration_seconds ELSE {second("end_at")} END AS end_second
           FROM trips""")
def playback_ends(t: Tables) -> DataFrame:
    start, end = F.col("start_at"), F.col("end_at")
    return t.trips.select(
        "journey_id",
        second_of_day(start).cast("bigint").alias("start_second"),
        playback_end(start, end, F.col("duration_seconds")).alias("end_second"),
    )


@query("""SELECT event_id, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_at
          FROM raw_parsed""")
def parse_datetime(t: Tables) -> DataFrame:
    rows = normalize.normalize_trips(t.raw_rows)
    return rows.select((F.col("source_row_number") - 1).alias("event_id"), _stamp("start_at"), _stamp("end_at"))


# -- normalize and validate ---------------------------------------------------


@query("""SELECT source_row_number, ['old', 'old_logical_terminal', 'old_spaced_station_columns', 'old_missing_end_station_id', 'new'][layout + 1] AS layout
          FROM raw""")
def detect_layout(t: Tables) -> DataFrame:
    return t.raw_rows.select("source_row_number", normalize.detect_layout(F.col("header")).alias("layout"))


_NORMALIZED = """SELECT journey_id, bike_id, bike_model, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at,
       strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_at, start_station_id, start_station_name, end_station_id, end_station_name,
       duration_seconds, duration_ms{more} FROM normalized"""


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    kept = [_stamp(c) if c in ("start_at", "end_at") else F.col(c) for c in TRIP_COLUMNS[:11]]
    return rows.select(*kept, *more)


@query(_NORMALIZED.format(more=", source_key, source_etag, source_row_number"))
def normalize_trips(t: Tables) -> DataFrame:
    return _flat(normalize.normalize_trips(t.raw_rows), "source_key", "source_etag", "source_row_number")


@query("SELECT source_row_number, duration_seconds, duration_ms FROM normalized")
def repair_duration(t: Tables) -> DataFrame:
    return normalize.normalize_trips(t.raw_rows).select("source_row_number", "duration_seconds", "duration_ms")


@query("""SELECT source_row_number, journey_id, duration_ms FROM flagged WHERE len(failed) = 0""")
def validate_valid(t: Tables) -> DataFrame:
    valid = validate.valid_trips(validate.check_trips(t.dirty))
    return valid.select("source_row_number", "journey_id", "duration_ms")


@query("""SELECT source_row_number, journey_id, array_to_string(list_sort(failed), ',') AS rules,
          CASE WHEN list_contains(failed, 'primary_key') THEN 'invalid' ELSE 'valid' END AS primary_key,
          CASE WHEN list_contains(failed, 'duration_ms|dtype') THEN 'invalid' ELSE 'valid' END AS duration_cast,
          CASE WHEN list_contains(failed, 'source_row_number|min') THEN 'invalid' ELSE 'valid' END AS number_min
          FROM flagged WHERE len(failed) > 0""")
def validate_rejects(t: Tables) -> DataFrame:
    rejects = validate.rejected_trips(validate.check_trips(t.dirty))
    rules = F.array_join(F.array_sort("failed_rules"), ",").alias("rules")
    more = {"duration_cast": "duration_ms|dtype", "number_min": "source_row_number|min"}
    return rejects.select("source_row_number", "journey_id", rules, "primary_key", *[F.col(f"`{c}`").alias(n) for n, c in more.items()])


@query("SELECT rule, count(*) AS rejected FROM (SELECT unnest(failed) AS rule FROM flagged) GROUP BY rule")
def rule_counts(t: Tables) -> DataFrame:
    return validate.rule_counts(validate.check_trips(t.dirty))


# -- stations -----------------------------------------------------------------


@query("""SELECT k.key, s.bikepoint_id, s.common_name, s.terminal_name, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon
          FROM name_lookup k JOIN stations s USING (ordinal)""")
def key_lookup(t: Tables) -> DataFrame:
    rows = stations.key_lookup(t.stations, "common_name_key")
    return rows.select("key", "bikepoint_id", "common_name", "terminal_name", _r("lat"), _r("lon"))


@query("""SELECT station_id, station_id_key, station_name, station_name_key, match_method, bikepoint_id AS matched_bikepoint_id,
          common_name AS matched_common_name, terminal_name AS matched_terminal_name, round(lat, 6) AS matched_lat, round(lon, 6) AS matched_lon
          FROM matches""")
def match_stations(t: Tables) -> DataFrame:
    named = stations.station_ends(t.trips).select("station_id", "station_name").distinct()
    return stations.match_stations(named, t.stations).withColumns({c: F.round(c, 6) for c in ("matched_lat", "matched_lon")})


@query("""SELECT DISTINCT coalesce(station_id, '') || chr(31) || coalesce(station_name, '') AS station_key, bikepoint_id,
          CASE WHEN match_method IS NULL THEN station_name ELSE common_name END AS name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM matches""")
def distinct_stations(t: Tables) -> DataFrame:
    rows = stations.distinct_stations(t.trips, t.stations)
    return rows.select("station_key", "bikepoint_id", "name", _r("lat"), _r("lon"))


_ACTIVITY = """SELECT day, station_id, station_name, sum(dep) AS dep, sum(arr) AS arr FROM ends GROUP BY ALL"""


@query("""SELECT station_id, station_name, cast(sum(dep) AS BIGINT) AS departure_count, cast(sum(arr) AS BIGINT) AS arrival_count,
          cast(sum(dep) + sum(arr) AS BIGINT) AS trip_count FROM ends GROUP BY ALL""")
def station_activity(t: Tables) -> DataFrame:
    return stations.station_activity(t.playback).orderBy(F.desc("trip_count"), "station_id", "station_name")


@query("""SELECT station_id, station_name, count(*) AS trip_count FROM (
            SELECT start_station_id AS station_id, start_station_name AS station_name FROM trips WHERE cast(start_at AS DATE) = DATE '2024-01-03'
            UNION ALL SELECT end_station_id, end_station_name FROM trips WHERE cast(start_at AS DATE) = DATE '2024-01-03')
          WHERE station_name IS NOT NULL GROUP BY ALL""")
def stations_for_day(t: Tables) -> DataFrame:
    return stations.stations_for_day(t.trips, DAY)


_SAMPLES = f"""SELECT e.sample_date, e.station_id, e.station_name, e.trip_count, m.* EXCLUDE (station_id, station_name) FROM (
      SELECT sample_date, station_id, station_name, count(*) AS trip_count FROM (
        SELECT cast(start_at AS DATE) AS sample_date, start_station_id AS station_id, start_station_name AS station_name FROM trips
        UNION ALL SELECT cast(start_at AS DATE), end_station_id, end_station_name FROM trips)
      WHERE sample_date IN ({_DAYS_SQL}) AND station_name IS NOT NULL GROUP BY ALL) e
    JOIN matches m ON m.station_id IS NOT DISTINCT FROM e.station_id AND m.station_name = e.station_name"""


def _samples(t: Tables) -> DataFrame:
    return stations.sample_station_matches(t.trips, t.stations, DAYS)


@query(f"""SELECT cast(sample_date AS VARCHAR) AS sample_date, station_id, station_name, trip_count, match_method,
           bikepoint_id AS matched_bikepoint_id, round(lat, 6) AS matched_lat FROM ({_SAMPLES})""")
def sample_station_matches(t: Tables) -> DataFrame:
    return _samples(t).select(
        _day("sample_date"), "station_id", "station_name", "trip_count", "match_method", "matched_bikepoint_id", _r("matched_lat")
    )


@query(f"""SELECT cast(sample_date AS VARCHAR) AS sample_date, coalesce(match_method, 'unmatched') AS match_method, count(*) AS stations
           FROM ({_SAMPLES}) GROUP BY ALL""")
def match_summary(t: Tables) -> DataFrame:
    return stations.match_summary(_samples(t)).withColumn("sample_date", F.col("sample_date").cast("string"))


@query(f"""SELECT cast(sample_date AS VARCHAR) AS sample_date, station_id, station_name, trip_count FROM ({_SAMPLES})
           WHERE match_method IS NULL ORDER BY trip_count DESC, sample_date, station_id NULLS FIRST, station_name LIMIT 25""")
def top_unmatched(t: Tables) -> DataFrame:
    return stations.top_unmatched(_samples(t)).withColumn("sample_date", F.col("sample_date").cast("string"))


@query("""SELECT station_key AS id, stationId, name, trip_count AS tripCount FROM (
            SELECT coalesce(e.station_id, '') || chr(31) || e.station_name AS station_key, e.station_id AS stationId, e.station_name AS name,
                   count(*) AS trip_count FROM ends e JOIN matches m ON m.station_id IS NOT DISTINCT FROM e.station_id AND m.station_name = e.station_name
            WHERE m.lat IS NOT NULL GROUP BY ALL)""")
def station_records(t: Tables) -> DataFrame:
    rows = stations.station_records(stations.station_matches(t.playback, t.stations))
    return rows.select("id", "stationId", "name", "tripCount")


@query("""SELECT station_id, station_name, count(*) AS trip_count FROM ends
          JOIN (SELECT station_id AS i, station_name AS n FROM matches WHERE lat IS NOT NULL) ON i IS NOT DISTINCT FROM station_id AND n = station_name
          WHERE contains(lower(station_name), 'area 1') GROUP BY station_id, station_name ORDER BY trip_count DESC, coalesce(station_id, '') || chr(31) || station_name LIMIT 8""")
def station_search(t: Tables) -> DataFrame:
    drawn = stations.station_matches(t.playback, t.stations).filter("lat IS NOT NULL AND lon IS NOT NULL")
    found = stations.station_search(drawn, " AREA 1 ")
    return found.select("station_id", "station_name", "trip_count")


# -- replay -------------------------------------------------------------------


@query("""SELECT journey_id, cast(day AS VARCHAR) AS day, start_bikepoint_id, end_bikepoint_id, start_match_method, end_match_method,
          round(start_lat, 6) AS start_lat, round(end_lon, 6) AS end_lon FROM matched""")
def matched_trips(t: Tables) -> DataFrame:
    ends = ["start_bikepoint_id", "end_bikepoint_id", "start_match_method", "end_match_method"]
    return replay.matched_trips(t.located).select("journey_id", _day(), *ends, _r("start_lat"), _r("end_lon"))


@query("""SELECT cast(day AS VARCHAR) AS day, count(*) AS total_trips, count(*) FILTER (ok) AS matched_trips, count(*) FILTER (NOT ok) AS unmatched_trips,
          any_value(station_count) AS station_count, count(*) FILTER (ok AND route_key IS NOT NULL) AS routed_trips
          FROM (SELECT *, start_lat IS NOT NULL AND end_lat IS NOT NULL AS ok FROM routed)
          JOIN (SELECT day, count(*) AS station_count FROM (SELECT DISTINCT day, station_id, station_name FROM ends) e
                JOIN matches m ON m.station_id IS NOT DISTINCT FROM e.station_id AND m.station_name = e.station_name
                WHERE m.lat IS NOT NULL GROUP BY day) USING (day) GROUP BY day""")
def day_summary(t: Tables) -> DataFrame:
    return replay.day_summary(t.routed, t.playback, t.stations).withColumn("day", F.col("day").cast("string"))


@query("""SELECT cast(d AS VARCHAR) AS day, count(r.journey_id) AS total_trips, count(*) FILTER (ok) AS matched_trips,
          count(*) FILTER (r.journey_id IS NOT NULL AND NOT ok) AS unmatched_trips, coalesce(any_value(station_count), 0) AS station_count,
          count(*) FILTER (ok AND route_key IS NOT NULL) AS routed_trips
          FROM (SELECT cast(unnest(['2023-12-31', '2024-01-03', '2024-02-29']) AS DATE) AS d)
          LEFT JOIN (SELECT *, start_lat IS NOT NULL AND end_lat IS NOT NULL AS ok FROM routed) r ON r.day = d
          LEFT JOIN (SELECT day, count(*) AS station_count FROM (SELECT DISTINCT day, station_id, station_name FROM ends) e
                JOIN matches m ON m.station_id IS NOT DISTINCT FROM e.station_id AND m.station_name = e.station_name
                WHERE m.lat IS NOT NULL GROUP BY day) c ON c.day = d GROUP BY d""")
def empty_days(t: Tables) -> DataFrame:
    days = replay.select_days(t.trips, [date(2023, 12, 31), DAY, date(2024, 2, 29), DAY])
    return replay.day_summary(t.routed, t.playback, t.stations, days).withColumn("day", F.col("day").cast("string"))


_ACTIVITY_BINS = """SELECT day, bin * 300 AS time, count(m.day2) AS active_trips FROM
      (SELECT DISTINCT day, unnest(range(0, 288)) AS bin FROM playback)
      LEFT JOIN (SELECT day AS day2, first_bin, last_bin FROM (
        SELECT day, s // 300 AS first_bin, CASE WHEN e < s THEN least(86399, s + duration_seconds) ELSE e END // 300 AS last_bin
        FROM (SELECT *, {s} AS s, {e} AS e FROM matched))) m
      ON m.day2 = day AND bin BETWEEN m.first_bin AND m.last_bin GROUP BY ALL""".format(s=second("start_at"), e=second("end_at"))


@query(f"SELECT cast(day AS VARCHAR) AS day, time, active_trips FROM ({_ACTIVITY_BINS})")
def activity_bins(t: Tables) -> DataFrame:
    return replay.activity_bins(t.located).select(_day(), "time", "active_trips")


@query(f"""SELECT cast(day AS VARCHAR) AS day, CASE WHEN hi > lo THEN lo ELSE 0 END AS domain_start, CASE WHEN hi > lo THEN hi ELSE 86399 END AS domain_end
           FROM (SELECT day, min(time) FILTER (busy) AS lo, max(time) FILTER (busy) AS hi FROM (
             SELECT *, active_trips >= greatest(1, floor(0.02 * max(active_trips) OVER (PARTITION BY day))) AS busy FROM ({_ACTIVITY_BINS}))
             GROUP BY day)""")
def activity_domain(t: Tables) -> DataFrame:
    return timeline.activity_domain(replay.activity_bins(t.located)).withColumn("day", F.col("day").cast("string"))


@query("""SELECT journey_id AS id, bike_id AS bikeId, bike_model AS bikeModel, start_second AS start, end_second AS "end", duration_seconds AS durationSeconds,
          start_station_id AS fromStationId, start_station_name AS fromStationName, end_station_id AS toStationId, end_station_name AS toStationName,
          round(start_lon, 6) AS from_lon, round(start_lat, 6) AS from_lat, round(end_lon, 6) AS to_lon, round(end_lat, 6) AS to_lat, r.route_key AS routeKey,
          p.shard_id AS routeShard, round(route_distance_meters, 3) AS routeDistanceMeters, route_reversed AS routeReversed
          FROM replay r LEFT JOIN (SELECT route_key AS packed_key, shard_id FROM packed_routes) p ON p.packed_key = r.route_key""")
def trip_records(t: Tables) -> DataFrame:
    rows = replay.trip_records(_sharded_replay(t))
    ends = {f"{side}_{name}": F.round(F.get(f"{side}Coord", at), 6) for side in ("from", "to") for at, name in enumerate(("lon", "lat"))}
    distance = F.round("routeDistanceMeters", 3).alias("routeDistanceMeters")
    plain = [c for c in rows.columns if c not in ("fromCoord", "toCoord", "routeDistanceMeters")]
    return rows.withColumns(ends).select(*plain, *ends, distance)


# -- pairs --------------------------------------------------------------------


@query("""SELECT r.pair_from, r.pair_to, r.trips, a.common_name AS from_name, round(a.lat, 6) AS from_lat, b.common_name AS to_name,
          round(b.lon, 6) AS to_lon FROM ranked r JOIN stations a ON a.bikepoint_id = r.pair_from JOIN stations b ON b.bikepoint_id = r.pair_to""")
def rank_pairs(t: Tables) -> DataFrame:
    rows = pairs.rank_pairs(t.trips, t.stations)
    return rows.select("pair_from", "pair_to", "trips", "from_name", _r("from_lat"), "to_name", _r("to_lon"))


@query(f"""SELECT pair_from, pair_to, trips FROM (SELECT * FROM ranked ORDER BY trips DESC, pair_from, pair_to LIMIT {PAIR_LIMIT}) h
           WHERE NOT EXISTS (SELECT 1 FROM cache_b c WHERE c.pair_from = h.pair_from AND c.pair_to = h.pair_to)""")
def pending_pairs(t: Tables) -> DataFrame:
    pending = pairs.pending_pairs(pairs.rank_pairs(t.trips, t.stations), t.cache_b, PAIR_LIMIT)
    return pending.select("pair_from", "pair_to", "trips")


@query(f"""SELECT 'candidate' AS name, count(*) AS pairs FROM (SELECT * FROM ranked LIMIT {PAIR_LIMIT})
           UNION ALL SELECT 'cached', count(*) FROM (SELECT DISTINCT pair_from, pair_to FROM cache_b)
           UNION ALL SELECT 'pending', count(*) FROM (SELECT * FROM ranked ORDER BY trips DESC, pair_from, pair_to LIMIT {PAIR_LIMIT}) h
           WHERE NOT EXISTS (SELECT 1 FROM cache_b c WHERE c.pair_from = h.pair_from AND c.pair_to = h.pair_to)""")
def pending_summary(t: Tables) -> DataFrame:
    return pairs.pending_summary(pairs.rank_pairs(t.trips, t.stations), t.cache_b, PAIR_LIMIT)


@query("""SELECT row_number() OVER w AS rank, pair_from, pair_to, trips, cast(sum(trips) OVER w AS BIGINT) AS cum_trips,
          round(sum(trips) OVER w / (SELECT sum(trips) FROM ranked), 9) AS cum_share FROM ranked
          WINDOW w AS (ORDER BY trips DESC, pair_from, pair_to)""")
def pair_coverage(t: Tables) -> DataFrame:
    return pairs.pair_coverage(pairs.rank_pairs(t.trips, t.stations)).withColumn("cum_share", F.round("cum_share", 9))


# -- routes -------------------------------------------------------------------


@query("""SELECT place AS ordinal, route_key, len(coordinates) AS points, round(coordinates[1][1], 6) AS first_lon, round(coordinates[-1][2], 6) AS last_lat,
          trip_count, round(distance_meters, 3) AS distance_meters FROM loaded WHERE place < 72057594037927936""")
def load_routes(t: Tables) -> DataFrame:
    at = F.element_at(F.element_at("coordinates", 1), 1), F.element_at(F.element_at("coordinates", -1), 2)
    return routes.load_routes(t.cache_a).select(
        "ordinal", "route_key", F.size("coordinates").alias("points"), F.round(at[0], 6).alias("first_lon"),
        F.round(at[1], 6).alias("last_lat"), "trip_count", _r("distance_meters", 3),
    )


@query("""SELECT place, route_key, pair_from, pair_to, len(coordinates) AS points, trip_count, round(distance_meters, 3) AS distance_meters FROM routes""")
def merge_providers(t: Tables) -> DataFrame:
    points = F.size("coordinates").alias("points")
    return t.routes.select("place", "route_key", "pair_from", "pair_to", points, "trip_count", _r("distance_meters", 3))


@query("""SELECT journey_id, route_key, round(route_distance_meters, 3) AS route_distance_meters, route_reversed FROM routed""")
def route_join(t: Tables) -> DataFrame:
    return t.routed.select("journey_id", "route_key", _r("route_distance_meters", 3), "route_reversed")


@query("""SELECT journey_id, u.i AS point, round(CASE WHEN route_reversed THEN coordinates[len(coordinates) + 1 - u.i] ELSE coordinates[u.i] END[1], 6) AS lon,
          round(CASE WHEN route_reversed THEN coordinates[len(coordinates) + 1 - u.i] ELSE coordinates[u.i] END[2], 6) AS lat
          FROM replay JOIN routes USING (route_key), (SELECT unnest(range(1, 10)) AS i) u WHERE u.i <= len(coordinates)""")
def route_path(t: Tables) -> DataFrame:
    paths = replay.path_trip_records(routes.with_route_path(t.replay, t.routes))
    points = paths.select(F.col("id").alias("journey_id"), F.posexplode("path").alias("at", "p"))
    lon, lat = F.round(F.get("p", 0), 6).alias("lon"), F.round(F.get("p", 1), 6).alias("lat")
    return points.select("journey_id", (F.col("at") + 1).cast("bigint").alias("point"), lon, lat)


@query("SELECT place, route_key, route_bytes, shard_id FROM packed_routes")
def pack_shards(t: Tables) -> DataFrame:
    return routes.pack_shards(t.routes, *SHARD_TARGET)


# -- state at a clock time ----------------------------------------------------


@query(f"""SELECT journey_id, clock FROM replay, {_CLOCKS_SQL} WHERE start_second <= clock AND end_second >= clock AND route_key IS NOT NULL""")
def active_at(t: Tables) -> DataFrame:
    return timeline.active_at(t.replay, CLOCKS, routed_only=True).select("journey_id", "clock")


@query(f"""SELECT cast(day AS VARCHAR) AS day, clock, count(*) FILTER (start_second <= clock) AS journeys,
           count(*) FILTER (start_second <= clock AND route_key IS NOT NULL) AS routed_journeys,
           count(*) FILTER (start_second <= clock AND route_key IS NULL) AS unrouted_journeys,
           round(coalesce(sum(route_distance_meters * least(1, (clock - start_second) / greatest(1, end_second - start_second))) FILTER (start_second <= clock), 0) / 1000, 3) AS routed_kilometres,
           count(*) FILTER (start_second <= clock AND end_second >= clock) AS active_trips,
           count(*) FILTER (start_second <= clock AND end_second >= clock AND route_key IS NOT NULL) AS active_routed_trips,
           count(*) FILTER (start_second <= clock AND end_second >= clock AND route_key IS NULL) AS active_unrouted_trips
           FROM replay, {_CLOCKS_SQL} GROUP BY ALL""")
def running_totals(t: Tables) -> DataFrame:
    rows = timeline.running_totals(t.replay, CLOCKS)
    return rows.withColumns({"day": F.col("day").cast("string"), "routed_kilometres": F.round("routed_kilometres", 3)})


_EVENTS = """SELECT day, start_station_key AS station_key, start_second AS second, 1 AS dep, 0 AS arr FROM replay
             UNION ALL SELECT day, end_station_key, end_second, 0, 1 FROM replay"""


@query(f"""SELECT cast(day AS VARCHAR) AS day, station_key, clock, cast(coalesce(sum(dep) FILTER (second <= clock), 0) AS BIGINT) AS departures,
           cast(coalesce(sum(arr) FILTER (second <= clock), 0) AS BIGINT) AS arrivals,
           cast(coalesce(sum(arr - dep) FILTER (second <= clock), 0) AS BIGINT) AS net FROM
           ({_EVENTS} UNION ALL SELECT DISTINCT e.day, coalesce(e.station_id, '') || chr(31) || e.station_name, 0, 0, 0 FROM ends e
            JOIN matches m ON m.station_id IS NOT DISTINCT FROM e.station_id AND m.station_name = e.station_name WHERE m.lat IS NOT NULL),
           {_CLOCKS_SQL} GROUP BY ALL""")
def station_balance(t: Tables) -> DataFrame:
    drawn = stations.station_records(stations.station_matches(t.playback, t.stations, F.col("day")), "day")
    return timeline.station_balance(t.replay, CLOCKS, drawn).withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT DISTINCT cast(day AS VARCHAR) AS day, station_key, second AS clock,
           cast(sum(dep) OVER w AS BIGINT) AS departures, cast(sum(arr) OVER w AS BIGINT) AS arrivals, cast(sum(arr - dep) OVER w AS BIGINT) AS net
           FROM ({_EVENTS}) WINDOW w AS (PARTITION BY day, station_key ORDER BY second RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def balance_timeline(t: Tables) -> DataFrame:
    return timeline.balance_timeline(t.replay).withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT clock, journey_id || '-' || kind AS id, kind, round(lon, 6) AS lon, clock - second AS age FROM (
             SELECT journey_id, 'departure' AS kind, start_second AS second, start_lon AS lon FROM replay
             UNION ALL SELECT journey_id, 'arrival', end_second, end_lon FROM replay), {_CLOCKS_SQL}
           WHERE second <= clock AND second >= clock - 90""")
def recent_events(t: Tables) -> DataFrame:
    rows = timeline.recent_events(t.replay, CLOCKS)
    return rows.select("clock", "id", "kind", F.round(F.get("coord", 0), 6).alias("lon"), "age")


@query("""SELECT journey_id, start_station_key, end_station_key FROM replay
          WHERE start_station_key IN (SELECT coalesce(station_id, '') || chr(31) || station_name FROM matches WHERE station_name IS NOT NULL AND ordinal % 10 = 4)
             OR end_station_key IN (SELECT coalesce(station_id, '') || chr(31) || station_name FROM matches WHERE station_name IS NOT NULL AND ordinal % 10 = 4)""")
def station_filter(t: Tables) -> DataFrame:
    named = stations.station_ends(t.trips).select("station_id", "station_name").distinct()
    matched = stations.match_stations(named, t.stations).filter("station_name IS NOT NULL")
    number = F.regexp_extract("matched_bikepoint_id", r"(\d+)$", 1).try_cast("bigint")
    chosen = matched.filter(number % 10 == 4).select("station_id", "station_name")
    return timeline.station_filter(t.replay, chosen).select("journey_id", "start_station_key", "end_station_key")


_TRACE = """
WITH active AS (SELECT journey_id, clock, route_reversed, coordinates AS route, start_lon AS x0, start_lat AS y0, end_lon - start_lon AS dx,
                  end_lat - start_lat AS dy, (clock - start_second) / greatest(1, end_second - start_second) AS p
                FROM replay LEFT JOIN routes USING (route_key), {clocks} WHERE start_second <= clock AND end_second >= clock),
  bent AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM active),
  drawn AS (SELECT journey_id, clock, p, CASE WHEN route IS NULL THEN list_transform(range(0, 25), lambda i: [
                x0 + dx * (i / 24.0::DOUBLE) + CASE WHEN d = 0 THEN 0 ELSE -dy / d END * sin(pi() * (i / 24.0::DOUBLE)) * least(0.012::DOUBLE, d * 0.22::DOUBLE),
                y0 + dy * (i / 24.0::DOUBLE) + CASE WHEN d = 0 THEN 0 ELSE dx / d END * sin(pi() * (i / 24.0::DOUBLE)) * least(0.012::DOUBLE, d * 0.22::DOUBLE)])
              WHEN route_reversed THEN list_reverse(route) ELSE route END AS path FROM bent),
  cut AS (SELECT *, len(path) - 1 AS n, least(1, greatest(0, p)) AS stop, greatest(0, least(1, greatest(0, p)) - 0.2::DOUBLE) AS begin FROM drawn),
  edge AS (SELECT *, cast(floor(begin * n) AS BIGINT) AS i0, cast(floor(stop * n) AS BIGINT) AS i1 FROM cut),
  piece AS (SELECT journey_id, clock, CASE WHEN n < 1 OR p <= 0 THEN [path[1]] ELSE list_concat([{first}], path[i0 + 2:i1 + 1], [{last}]) END AS path FROM edge)
SELECT journey_id, clock, cast(u.i AS BIGINT) AS point, round(path[u.i][1], 6) AS lon, round(path[u.i][2], 6) AS lat
FROM piece, (SELECT unnest(range(1, 40)) AS i) u WHERE u.i <= len(path)"""


def _sql_point(share: str, index: str) -> str:
    ends = f"CASE WHEN {share} <= 0 THEN path[1] WHEN {share} >= 1 THEN path[n + 1] ELSE "
    axes = ", ".join(
        f"path[{index} + 1][{a}] + (path[{index} + 2][{a}] - path[{index} + 1][{a}]) * ({share} * n - {index})" for a in (1, 2)
    )
    return f"{ends}[{axes}] END"


@query("SELECT * FROM (" + _TRACE.format(clocks=_CLOCKS_SQL, first=_sql_point("begin", "i0"), last=_sql_point("stop", "i1")) + ")")
def trip_traces(t: Tables) -> DataFrame:
    traces = timeline.trip_traces(t.replay, t.routes, CLOCKS, 0.2)
    points = traces.select("journey_id", "clock", F.posexplode("path").alias("at", "p"))
    lon, lat = F.round(F.get("p", 0), 6).alias("lon"), F.round(F.get("p", 1), 6).alias("lat")
    return points.select("journey_id", "clock", (F.col("at") + 1).cast("bigint").alias("point"), lon, lat)


@query("""SELECT DISTINCT cast(day AS VARCHAR) AS day, r.route_key, p.shard_id AS route_shard FROM replay r
          JOIN (SELECT route_key AS packed_key, shard_id FROM packed_routes) p ON p.packed_key = r.route_key""")
def required_routes(t: Tables) -> DataFrame:
    return timeline.required_routes(_sharded_replay(t)).select(_day(), "route_key", "route_shard")


@query("""SELECT cast(day AS VARCHAR) AS day, trips, round(trips / max(trips) OVER (), 6) AS share, dayofweek(day) = 1 AS is_monday, day(day) = 1 AS is_month_start,
          strftime(day, '%m-%d') = '01-01' AS is_year_start, 'w/c ' || day(day) || ' ' || strftime(day, '%b') AS week_label,
          strftime(day, '%b %Y') AS month_label, strftime(day, '%Y') AS year_label, strftime(day, '%A') AS weekday
          FROM (SELECT day, count(*) AS trips FROM matched GROUP BY day)""")
def volume_histogram(t: Tables) -> DataFrame:
    days = replay.matched_trips(t.located).groupBy("day").agg(F.count(F.lit(1)).alias("trips"))
    return timeline.volume_histogram(days).withColumns({"day": F.col("day").cast("string"), "share": F.round("share", 6)})


# -- ledger -------------------------------------------------------------------

_JOINED = """(SELECT coalesce(l.source_key, g.source_key) AS source_key, l.position, l.source_key IS NOT NULL AS listed, g.source_key IS NULL AS fresh,
  l.source_key IS NOT NULL AND g.source_key IS NOT NULL AND
    (l.etag IS DISTINCT FROM g.etag OR l.size_bytes IS DISTINCT FROM g.size_bytes OR l.last_modified IS DISTINCT FROM g.last_modified) AS changed,
  l.etag AS new_etag, l.size_bytes AS new_size, g.* EXCLUDE (source_key)
  FROM (SELECT * FROM listing WHERE size_bytes > 0) l FULL JOIN ledger g ON g.source_key = l.source_key)"""


def _plan(t: Tables, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    return ledger.plan_raw(t.listing.filter("size_bytes > 0"), t.ledger, ["position"], limit, now=F.lit("now"))


@query(f"""SELECT source_key, CASE WHEN fresh OR changed THEN new_etag ELSE etag END AS etag,
           CASE WHEN fresh OR changed THEN new_size ELSE size_bytes END AS size_bytes,
           CASE WHEN fresh OR changed THEN 'pending' ELSE raw_status END AS raw_status,
           CASE WHEN fresh OR changed THEN 'pending' ELSE normalized_status END AS normalized_status,
           CASE WHEN fresh OR changed THEN NULL ELSE normalized_path END AS normalized_path,
           CASE WHEN fresh OR changed THEN NULL ELSE row_count_raw END AS row_count_raw,
           CASE WHEN fresh OR changed THEN NULL ELSE error_message END AS error_message,
           CASE WHEN fresh THEN 'now' ELSE '2024-01-01 00:00:00' END AS discovered_at FROM {_JOINED}""")
def plan_raw_ledger(t: Tables) -> DataFrame:
    return _plan(t)[0].select(
        "source_key", "etag", "size_bytes", "raw_status", "normalized_status", "normalized_path", "row_count_raw", "error_message", "discovered_at"
    )


@query(f"""SELECT source_key, new_size AS size_bytes, new_etag AS etag FROM {_JOINED} WHERE listed AND (fresh OR changed OR raw_status <> 'downloaded')
           ORDER BY position LIMIT {PLAN_LIMIT}""")
def plan_raw(t: Tables) -> DataFrame:
    return _plan(t, PLAN_LIMIT)[1].select("source_key", "size_bytes", "etag")


@query(f"""SELECT source_key, etag FROM ledger WHERE raw_status = 'downloaded' AND normalized_status IN ('pending', 'failed')
           ORDER BY source_key LIMIT {PLAN_LIMIT}""")
def plan_normalize(t: Tables) -> DataFrame:
    return ledger.plan_normalize(t.ledger, retry_failed=True, limit=PLAN_LIMIT).select("source_key", "etag")


@query("""SELECT source_key, normalized_path FROM ledger WHERE normalized_status = 'normalized' AND validated_status IN ('pending', 'failed', 'validated')""")
def plan_validate(t: Tables) -> DataFrame:
    return ledger.plan_validate(t.ledger, retry_failed=True, force=True).select("source_key", "normalized_path")


_OUTCOME = """SELECT source_key, normalized_path, row_count_raw, CASE WHEN normalized_status <> 'pending' THEN normalized_status
   WHEN k % 3 = 0 THEN 'normalized' WHEN k % 3 = 1 THEN 'skipped' ELSE 'failed' END AS normalized_status, normalized_status = 'pending' AS done, error_message, schema_version, k FROM ledger"""


@query(f"""SELECT source_key, normalized_status, CASE WHEN NOT done THEN normalized_path WHEN normalized_status = 'normalized' THEN 'p/' || source_key
             WHEN normalized_status = 'skipped' THEN NULL ELSE normalized_path END AS normalized_path,
           CASE WHEN NOT done THEN row_count_raw WHEN normalized_status = 'normalized' THEN 7 WHEN normalized_status = 'skipped' THEN 0 ELSE row_count_raw END AS row_count_raw,
           CASE WHEN NOT done THEN error_message WHEN normalized_status = 'normalized' THEN NULL ELSE 'why' END AS error_message,
           CASE WHEN done AND normalized_status = 'normalized' THEN 'trips_v1' ELSE schema_version END AS schema_version,
           CASE WHEN done THEN 'now' END AS processed_at FROM ({_OUTCOME})""")
def apply_outcomes(t: Tables) -> DataFrame:
    number = F.regexp_extract("source_key", r"(\d+)", 1).cast("bigint") % 3
    status = F.when(number == 0, "normalized").when(number == 1, "skipped").otherwise("failed")
    outcomes = t.ledger.filter("normalized_status = 'pending'").select(
        "source_key",
        status.alias("status"),
        F.when(number != 0, "why").alias("error"),
        F.lit(7).alias("rows"),
        F.lit(7).alias("raw_rows"),
        F.concat(F.lit("p/"), "source_key").alias("path"),
    )
    stamped = ledger.apply_outcomes(t.ledger, outcomes, "normalize", F.lit("now"))
    kept = ["source_key", "normalized_status", "normalized_path", "row_count_raw", "error_message", "schema_version", "processed_at"]
    return stamped.select(*kept)


@query("""SELECT source_key, CASE WHEN position % 3 = 0 THEN 'failed' ELSE 'downloaded' END AS status FROM listing WHERE size_bytes > 0""")
def check_downloads(t: Tables) -> DataFrame:
    landed = t.listing.filter((F.col("position") % 6 != 0)).select(
        "source_key", (F.col("size_bytes") - F.when(F.col("position") % 3 == 0, 1).otherwise(0)).alias("landed_bytes")
    )
    return ledger.check_downloads(t.listing.filter("size_bytes > 0"), landed).select("source_key", "status")


@query("""SELECT source_key, count(*) FILTER (len(failed) = 0) AS valid_rows, count(*) FILTER (len(failed) > 0) AS invalid_rows,
          CASE WHEN count(*) FILTER (len(failed) = 0) = 0 THEN 'failed' ELSE 'validated' END AS status FROM flagged GROUP BY source_key""")
def validation_outcome(t: Tables) -> DataFrame:
    valid = F.size("failed_rules") == 0
    counts = validate.check_trips(t.dirty).groupBy("source_key").agg(
        F.count_if(valid).alias("valid_rows"), F.count_if(~valid).alias("invalid_rows")
    )
    return ledger.validation_outcome(counts).select("source_key", "valid_rows", "invalid_rows", "status")


# -- landed files -------------------------------------------------------------


@query("SELECT source_key, size_bytes, last_modified, etag FROM listing WHERE size_bytes > 0 AND source_key <> 'files/7.csv'")
def read_listing(t: Tables) -> DataFrame:
    rows = listing.read_listing(t.spark, landing.listing_pages(t), prefix="files/7.csv")
    return rows.select("source_key", "size_bytes", "last_modified", "etag")


def _landed_trips(rows: DataFrame) -> DataFrame:
    provenance = rows.withColumn("source_key", F.lit("k")).withColumn("source_etag", F.lit("e"))
    return normalize.normalize_trips(provenance)


@query(_NORMALIZED.format(more=""))
def read_trip_csv(t: Tables) -> DataFrame:
    return _flat(_landed_trips(trip_files.read_trip_csv(t.spark, landing.trip_csv(t))))


@query(_NORMALIZED.format(more=", 'layout' || (event_id % 5) || '.CSV' AS source_member")
       .replace("bike_model,", "CASE WHEN bike_model IS NOT NULL THEN 'Café ' || bike_model END AS bike_model,")
       .replace("FROM normalized", "FROM (SELECT *, source_row_number - 1 AS event_id FROM normalized)"))
def read_zip_members(t: Tables) -> DataFrame:
    rows = trip_files.read_zip_members(t.spark, landing.trip_zip(t))
    return _flat(_landed_trips(rows), "source_member")


@query("SELECT 'layout' || (event_id % 5) || '.CSV' AS source_member, count(DISTINCT event_id // 1000) AS archives FROM raw GROUP BY 1")
def zip_directory(t: Tables) -> DataFrame:
    members = trip_files.zip_directory(t.spark, landing.trip_zip(t))
    return members.groupBy("source_member").agg(F.count(F.lit(1)).alias("archives"))


@query("""SELECT DISTINCT 'trips-' || (event_id // 1000) || '.zip' AS archive, 'layout' || (event_id % 5) || '.CSV' AS source_member
          FROM raw WHERE event_id % 5 < 3 AND event_id // 1000 % 2 = 0""")
def duplicate_members(t: Tables) -> DataFrame:
    directory = trip_files.zip_directory(t.spark, landing.trip_zip(t))
    known = trip_files.csv_fingerprints(t.spark, [landing.member_copies(t)])
    name = F.regexp_extract("file", r"([^/]+)$", 1).alias("archive")
    return trip_files.duplicate_members(directory, known).select(name, "source_member")


@query("""SELECT ordinal, bikepoint_id AS id, ' ' || common_name AS "commonName", round(lat, 6) AS lat, round(lon, 6) AS lon, 8 AS properties FROM stations""")
def read_station_master(t: Tables) -> DataFrame:
    rows = station_master.read_station_master(t.spark, landing.station_json(t))
    return rows.select("ordinal", "id", "commonName", _r("lat"), _r("lon"), F.size("additionalProperties").alias("properties"))


@query(f"""SELECT bikepoint_id, bikepoint_number, {sql_numeric_key("bikepoint_number")} AS bikepoint_number_key, terminal_name,
           {sql_numeric_key("terminal_name")} AS terminal_name_key, common_name, {sql_name_key("common_name")} AS common_name_key,
           installed, CASE WHEN ordinal % 4 <> 0 THEN locked END AS locked, temporary,
           strftime(TIMESTAMP '2010-07-12 15:08:00' + to_days(cast(ordinal AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS install_date,
           cast(NULL AS VARCHAR) AS removal_date, nb_docks, cast(NULL AS BIGINT) AS nb_bikes FROM stations""")
def flatten_stations(t: Tables) -> DataFrame:
    flat = station_master.flatten_stations(landing.station_objects(t))
    keys = ["bikepoint_id", "bikepoint_number", "bikepoint_number_key", "terminal_name", "terminal_name_key", "common_name"]
    return flat.select(
        *keys, "common_name_key", "installed", "locked", "temporary", _stamp("install_date"), _stamp("removal_date"), "nb_docks", "nb_bikes"
    )


def _written_trips(t: Tables) -> str:
    path = fresh_path(t.spark, "trips-by-source")
    trips.write_by_source(t.trips, path)
    return path


@query("SELECT source_key, count(*) AS trips, cast(sum(duration_seconds) AS BIGINT) AS seconds FROM trips GROUP BY source_key")
def scan_trips(t: Tables) -> DataFrame:
    rows = trips.scan_trips(t.spark, _written_trips(t))
    return rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("trips"), F.sum("duration_seconds").alias("seconds"))


@query("SELECT journey_id, source_member, bike_model, source_row_number FROM trips")
def scan_with_defaults(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "old-trips")
    t.trips.drop("source_member").withColumn("extra", F.lit(1)).write.parquet(path)
    return trips.scan_with_defaults(t.spark, path).select("journey_id", "source_member", "bike_model", "source_row_number")


@query("""SELECT source_key, count(*) AS trips FROM trips WHERE source_key <> '2024-01-03.csv' GROUP BY source_key
          UNION ALL SELECT source_key, count(*) FROM trips WHERE source_key = '2024-01-03.csv' AND duration_seconds > 600 GROUP BY source_key""")
def write_by_source(t: Tables) -> DataFrame:
    path = _written_trips(t)
    again = t.trips.filter((F.col("source_key") == "2024-01-03.csv") & (F.col("duration_seconds") > 600))
    trips.write_by_source(again, path)
    return trips.scan_trips(t.spark, path).groupBy("source_key").agg(F.count(F.lit(1)).alias("trips"))


_RESPONSES = """SELECT pair_from, pair_to, trip_count,
    CASE WHEN failed OR k % 5 IN (1, 2) THEN NULL ELSE distance END AS distance_meters, {more}
    CASE WHEN failed OR k % 5 IN (1, 2) {bare} THEN 'null' ELSE 'line' END AS geometry,
    CASE WHEN failed THEN 'TimeoutError pair ' || ordinal WHEN k % 5 = 1 THEN '404' ELSE 'null' END AS error
    FROM (SELECT *, k % 7 = 3 AS failed, j AS trip_count, cast(abs(a - b) * 100 + j AS DOUBLE) AS distance FROM route_pairs)"""


def _plain(snapshot: DataFrame, *more: str) -> DataFrame:
    line = F.when(F.col("geometry") == "null", "null").when(F.col("geometry").contains("[3.5,4.5]"), "line")
    message = F.concat_ws(" ", F.get_json_object("error", "$.type"), F.get_json_object("error", "$.message"))
    told = F.coalesce(F.get_json_object("error", "$.status"), F.nullif(message, F.lit("")), F.col("error"))
    return snapshot.select("pair_from", "pair_to", "trip_count", "distance_meters", *more, line.alias("geometry"), told.alias("error"))


@query(_RESPONSES.format(more="CASE WHEN failed THEN 'FetchError' WHEN k % 5 = 1 THEN 'HttpError' WHEN k % 5 <> 2 THEN 'Ok' END AS code,", bare="OR k % 4 = 0"))
def parse_route_responses(t: Tables) -> DataFrame:
    rows = route_cache.parse_route_responses(landing.responses(t, "mapbox"), "mapbox")
    return _plain(route_cache.route_cache_snapshot(rows), "code")


@query(_RESPONSES.format(more="CASE WHEN failed OR k % 5 IN (1, 2) THEN NULL ELSE '58s' END AS static_duration,", bare=""))
def route_cache_snapshot(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "route-cache")
    rows = route_cache.parse_route_responses(landing.responses(t, "google"), "google")
    even = F.xxhash64("pair_from", "pair_to") % 2 == 0
    route_cache.append_routes(rows.filter(even), path)
    route_cache.append_routes(rows.filter(~even), path)
    return _plain(route_cache.route_cache_snapshot(route_cache.read_route_lines(t.spark, path)), "static_duration")


# -- export -------------------------------------------------------------------


def _exported(t: Tables) -> tuple[str, DataFrame]:
    root = fresh_path(t.spark, "export")
    row, _ = export.export(t.trips, t.stations, t.routes, "all", root, target_gzip_bytes=SHARD_TARGET[0], compression_ratio=SHARD_TARGET[1])
    return root, row


@query("""SELECT cast(d.day AS VARCHAR) AS day, coalesce(r.trips, 0) AS trips, r.first_id, r.end_sum, coalesce(r.routed, 0) AS routed, 288 AS bins, d.total
          FROM (SELECT cast(start_at AS DATE) AS day, count(*) FILTER (end_station_name IS NOT NULL) AS total FROM trips GROUP BY 1) d LEFT JOIN
          (SELECT day, count(*) AS trips, min(journey_id) AS first_id, cast(sum(end_second) AS BIGINT) AS end_sum, count(route_key) AS routed
           FROM replay GROUP BY day) r ON r.day = d.day""")
def load_day(t: Tables) -> DataFrame:
    days = export.load_day(t.spark, _exported(t)[0], characters=export.STRETCH_CHARACTERS)
    # The slice with a day's activity may hold no trip, and a day no trip at all.
    trip = days.select("date", F.explode_outer("trips").alias("trip"), F.size("activity").alias("bins"), "summary.totalTrips")
    return trip.groupBy(F.col("date").alias("day")).agg(
        F.count("trip.id").alias("trips"),
        F.min("trip.id").alias("first_id"),
        F.sum("trip.end").alias("end_sum"),
        F.count("trip.routeKey").alias("routed"),
        F.max("bins").alias("bins"),
        F.max("totalTrips").alias("total"),
    )


@query("""SELECT route_key, len(coordinates) AS points, round(coordinates[1][1], 6) AS lon FROM routes WHERE route_key IN (SELECT route_key FROM replay)""")
def load_shard(t: Tables) -> DataFrame:
    packed = routes.pack_shards(t.routes, *SHARD_TARGET)
    wanted = packed.join(timeline.required_routes(t.replay).select("route_key").distinct(), "route_key", "left_semi")
    found = export.load_shard(t.spark, _exported(t)[0], wanted)
    lon = F.round(F.element_at(F.element_at("coordinates", 1), 1), 6).alias("lon")
    return found.select("route_key", F.size("coordinates").alias("points"), lon)


def _day_documents(t: Tables) -> DataFrame:
    routed = staged(t.routed, "routed")
    matches = staged(stations.station_matches(routed, t.stations, F.col("day")), "day-stations")
    summary = replay.day_summary(routed, routed, t.stations, matches=matches)
    records = stations.station_records(matches, "day")
    return export.day_documents(replay.replay_trips(routed), records, replay.activity_bins(routed), summary)


_SLICES = """(SELECT day, part, count(journey_id) AS trips, count(route_key) AS routed FROM
    (SELECT DISTINCT day, 0 AS part, NULL AS journey_id, NULL AS route_key FROM playback
     UNION ALL SELECT day, {s} // 21600, journey_id, route_key FROM replay) GROUP BY day, part)""".format(s=second("start_at"))


@query(f"SELECT cast(day AS VARCHAR) AS id, part, trips AS trips_in_slice, routed AS routed_in_slice FROM {_SLICES}")
def export_days(t: Tables) -> DataFrame:
    return export.day_counts(_day_documents(t)).drop("kind")


@query(f"""SELECT 'day' AS kind, cast(day AS VARCHAR) AS id, count(*) AS documents, count(*) AS of_that_size, count(*) AS named_by_content,
           count(*) AS packed_smaller FROM {_SLICES} GROUP BY day""")
def export_sizes(t: Tables) -> DataFrame:
    root = fresh_path(t.spark, "day-export")
    sizes = export.export_sizes(export.write_days(_day_documents(t), root).drop("gzip_bytes"), root)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    contents = files.select(name.alias("name"), F.substring(F.sha2("content", 256), 1, export.HASH_DIGITS).alias("of_content"))
    found = sizes.withColumn("name", name).join(contents, "name", "left")
    return found.groupBy("kind", "id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("file_bytes") == F.col("bytes")).alias("of_that_size"),
        F.count_if((F.col("of_content") == F.col("hash")) & F.col("name").contains(F.col("hash"))).alias("named_by_content"),
        F.count_if(F.col("gzip_bytes") < F.col("file_bytes")).alias("packed_smaller"),
    )


@query("""SELECT p.shard_id AS id, count(DISTINCT r.route_key) AS routes_in_shard, min(r.route_key) AS first_key, max(r.route_key) AS last_key,
          cast(sum(len(coordinates)) AS BIGINT) AS points, cast(sum(list_sum(list_transform(coordinates, lambda c: cast(round(c[1] * 1000000) AS BIGINT)))) AS BIGINT) AS micro_lon_sum
          FROM routes r JOIN (SELECT route_key AS packed_key, shard_id FROM packed_routes) p ON p.packed_key = r.route_key GROUP BY p.shard_id""")
def export_shards(t: Tables) -> DataFrame:
    packed = routes.pack_shards(t.routes, *SHARD_TARGET)
    documents = export.shard_documents(t.routes, packed, "all")
    body = F.from_json("json", "version int, routes map<string, array<array<double>>>")
    entries = documents.select("id", "routes_in_shard", F.explode(body["routes"]).alias("key", "coordinates"))
    # Whole millionths: sums of fractions depend on their order.
    lon = F.aggregate("coordinates", F.lit(0).cast("bigint"), lambda total, c: total + F.round(c[0] * 1_000_000).cast("bigint"))
    return entries.groupBy("id", "routes_in_shard").agg(
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.sum(F.size("coordinates")).alias("points"),
        F.sum(lon).alias("micro_lon_sum"),
    )


@query("""SELECT 0 AS part, row_number() OVER (ORDER BY bikepoint_id, ordinal) - 1 AS place, bikepoint_id AS "bikepointId", bikepoint_number AS "bikepointNumber",
          common_name AS name, terminal_name AS "terminalName", round(lon, 6) AS lon, round(lat, 6) AS lat, installed, locked, temporary, nb_docks AS "nbDocks"
          FROM stations""")
def station_master_document(t: Tables) -> DataFrame:
    schema = """version int, stations array<struct<bikepointId: string, bikepointNumber: string, name: string, terminalName: string,
        coord: array<double>, installed: boolean, locked: boolean, temporary: boolean, nbDocks: bigint>>"""
    pages = export.station_master_document(t.stations)
    listed = pages.select("part", F.posexplode(F.from_json("json", schema)["stations"]).alias("place", "s")).select("part", "place", "s.*")
    coord = [F.round(F.get("coord", at), 6).alias(name) for at, name in enumerate(("lon", "lat"))]
    return listed.select("part", F.col("place").cast("bigint").alias("place"), *[c for c in listed.columns[2:] if c != "coord"], *coord)


@query(f"""SELECT 1 AS version, (SELECT count(*) FROM trips) AS trip_count, (SELECT count(*) FROM routes) AS route_count,
          (SELECT count(*) FROM stations) AS station_count, (SELECT count(*) FROM stations) AS listed_stations, cast(day AS VARCHAR) AS date,
          cast(sum(trips) AS BIGINT) AS trips, cast(sum(routed) AS BIGINT) AS routed_trips, count(*) AS slices,
          string_agg(part || ':' || trips || ':' || routed, ',' ORDER BY part) AS slice_counts FROM {_SLICES} GROUP BY day""")
def manifest(t: Tables) -> DataFrame:
    row = _exported(t)[1]
    listed = F.aggregate("files.bikepoints.files", F.lit(0).cast("bigint"), lambda total, f: total + f["stationCount"])
    each = row.select("version", "dateRange", "files", listed.alias("listed"), F.explode("days").alias("d"))
    counts = F.transform("d.slices", lambda s: F.concat_ws(":", s["slice"], s["trips"], s["routedTrips"]))
    return each.select(
        "version",
        F.col("dateRange.tripCount").alias("trip_count"),
        F.col("files.routes.routeCount").alias("route_count"),
        F.col("files.bikepoints.stationCount").alias("station_count"),
        F.col("listed").alias("listed_stations"),
        F.col("d.date").alias("date"),
        F.col("d.trips").alias("trips"),
        F.col("d.routedTrips").alias("routed_trips"),
        F.size("d.slices").alias("slices"),
        F.array_join(counts, ",").alias("slice_counts"),
    )


# -- catalog ------------------------------------------------------------------


def _catalog(t: Tables) -> list[str]:
    root = fresh_path(t.spark, "catalog")
    trips.write_by_source(t.trips, f"{root}/{catalog.TRIP_VIEWS['trips']}")
    t.stations.write.parquet(f"{root}/{catalog.TABLE_VIEWS['bikepoints']}")
    coverage = pairs.pair_coverage(pairs.rank_pairs(t.trips, t.stations))
    coverage.write.parquet(f"{root}/{catalog.TABLE_VIEWS['route_pair_coverage']}")
    return catalog.register_views(t.spark, root)


@query("""SELECT 'trips' AS name, count(*) AS rows FROM trips UNION ALL SELECT 'bikepoints', count(*) FROM stations
          UNION ALL SELECT 'route_pair_coverage', count(*) FROM ranked""")
def register_views(t: Tables) -> DataFrame:
    counts = [f"SELECT '{name}' AS name, count(*) AS rows FROM {name}" for name in _catalog(t)]
    return catalog.run_sql(t.spark, " UNION ALL ".join(counts) + ";")


@query("""SELECT s.bikepoint_id, count(*) AS trips, avg(t.duration_seconds) > 3000 AS long FROM trips t
          JOIN stations s ON s.terminal_name = t.start_station_id GROUP BY s.bikepoint_id""")
def run_sql(t: Tables) -> DataFrame:
    _catalog(t)
    return catalog.run_sql(
        t.spark,
        """SELECT b.bikepoint_id, count(*) AS trips, avg(t.duration_seconds) > 3000 AS long
           FROM trips t JOIN bikepoints b ON b.terminal_name = t.start_station_id GROUP BY b.bikepoint_id;""",
    )
