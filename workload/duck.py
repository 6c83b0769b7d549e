"""The tables of ``tables.py`` as SQL, for the side-by-side check."""

from __future__ import annotations

import re

_NAME = "'Dock ' || cast({k} - CASE WHEN {k} % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR) || ', Area ' || cast({k} % 20 AS VARCHAR)"


def _named(k: str, e: str) -> str:
    name = _NAME.format(k=k)
    return f"CASE WHEN {e} % 5 = 0 THEN upper({name}) ELSE {name} END"


def _station_id(k: str, e: str) -> str:
    return (
        f"CASE WHEN {e} % 4 = 0 THEN cast({k} AS VARCHAR) WHEN {e} % 4 = 1 THEN '00' || cast({k} AS VARCHAR) "
        f"WHEN {e} % 4 = 2 THEN cast({k} + 2000000 AS VARCHAR) ELSE 'T' END"
    )


def numeric_key(text: str) -> str:
    digits = f"nullif(regexp_replace({text}, '[^0-9]+', '', 'g'), '')"
    return f"CASE WHEN {digits} IS NOT NULL THEN coalesce(nullif(ltrim({digits}, '0'), ''), '0') END"


def name_key(text: str) -> str:
    return f"nullif(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), '')"


def second(at: str) -> str:
    return f"(hour({at}) * 3600 + minute({at}) * 60 + second({at}))"


def _cache(every: int) -> str:
    return f"""
    SELECT ordinal, pair_from, pair_to,
           CASE WHEN k % 13 = 5 THEN 'null' ELSE '{{"type":"LineString","coordinates":[' || CASE WHEN k % 17 = 3 THEN '' ELSE
             array_to_string(list_transform(range(0, 3 + k % 4), lambda i:
               '[' || cast(round(a / 1000 - 3.0::DOUBLE + (b - a) / 1000 * i / (2 + k % 4), 6) AS VARCHAR) || ',' ||
               cast(round(51.5::DOUBLE + a / 1000 + (b - a) / 1000 * i / (2 + k % 4), 6) AS VARCHAR) || ']'), ',') END
             || ']}}' END AS geometry,
           CASE WHEN k % 13 = 5 THEN '{{"type":"FetchError"}}' ELSE 'null' END AS error,
           CASE WHEN k % 5 <> 0 THEN k + {every} END AS trip_count,
           abs(a - b) * 100.0::DOUBLE + j * 7.5::DOUBLE + {every} AS distance_meters
    FROM route_pairs WHERE (k + j) % {every} = 0"""


def _loaded(cache: str, rank: int) -> str:
    return f"""
    SELECT * FROM (SELECT {rank} * 72057594037927936::BIGINT + ordinal AS place, pair_from, pair_to, pair_from || '|' || pair_to AS route_key,
           CASE WHEN geometry <> 'null' THEN cast(json_extract(geometry, '$.coordinates') AS DOUBLE[][]) END AS coordinates,
           coalesce(trip_count, 0) AS trip_count, distance_meters
    FROM {cache} WHERE (error IS NULL OR error = 'null') AND geometry IS NOT NULL AND geometry <> 'null')
    WHERE len(coordinates) > 0"""


_LOOKUP = """
    SELECT {key} AS key, arg_min(ordinal, {order}) AS ordinal FROM ({rows}) WHERE {key} IS NOT NULL AND {key} <> '' GROUP BY 1"""

CTES = {
    "trips": f"""
    SELECT cast(event_id AS VARCHAR) AS journey_id, cast(user_id AS VARCHAR) AS bike_id, event_type AS bike_model,
           ts AS start_at, ts + to_seconds(seconds) AS end_at,
           {_station_id("user_id", "event_id")} AS start_station_id, {_named("user_id", "event_id")} AS start_station_name,
           CASE WHEN event_id % 10 <> 7 THEN {_station_id("goal", "(event_id + 1)")} END AS end_station_id,
           CASE WHEN event_id % 97 <> 0 THEN {_named("goal", "(event_id + 1)")} END AS end_station_name,
           seconds AS duration_seconds, seconds * 1000 AS duration_ms,
           cast(cast(ts AS DATE) AS VARCHAR) || '.csv' AS source_key, 'etag-' || cast(cast(ts AS DATE) AS VARCHAR) AS source_etag,
           cast(NULL AS VARCHAR) AS source_member, event_id + 1 AS source_row_number, event_id
    FROM (SELECT *, cast(floor(value * 240) AS BIGINT) AS seconds,
                 CASE WHEN event_id % 9 = 0 THEN user_id ELSE user_id // 2 + event_id % 11 END AS goal FROM events)""",
    "stations": f"""
    SELECT s_suppkey AS ordinal, 'BikePoints_' || s_suppkey AS bikepoint_id, cast(s_suppkey AS VARCHAR) AS bikepoint_number,
           CASE WHEN s_suppkey % 7 <> 0 THEN cast(s_suppkey + 2000000 AS VARCHAR) END AS terminal_name,
           {_NAME.format(k="s_suppkey")} AS common_name,
           CASE WHEN s_suppkey % 23 <> 5 THEN 51.5::DOUBLE + s_suppkey / 1000 END AS lat, s_suppkey / 1000 - 3.0::DOUBLE AS lon,
           s_suppkey % 2 = 0 AS installed, s_suppkey % 3 = 0 AS locked, false AS temporary, cast(s_nationkey AS BIGINT) AS nb_docks
    FROM supplier""",
    "id_lookup": _LOOKUP.format(
        key="key",
        order="rank * 1000000000 + ordinal",
        rows=f"SELECT {numeric_key('bikepoint_number')} AS key, 0 AS rank, ordinal FROM stations UNION ALL "
        f"SELECT {numeric_key('terminal_name')}, 1, ordinal FROM stations",
    ),
    "number_keys": f"SELECT DISTINCT {numeric_key('bikepoint_number')} AS key FROM stations",
    "name_lookup": _LOOKUP.format(
        key="key", order="ordinal", rows=f"SELECT {name_key('common_name')} AS key, ordinal FROM stations"
    ),
    "named": """
    SELECT DISTINCT station_id, station_name FROM (
      SELECT start_station_id AS station_id, start_station_name AS station_name FROM trips
      UNION ALL SELECT end_station_id, end_station_name FROM trips)""",
    "matches": f"""
    SELECT n.station_id, n.station_name, {numeric_key("n.station_id")} AS station_id_key, {name_key("n.station_name")} AS station_name_key,
           CASE WHEN i.ordinal IS NOT NULL THEN CASE WHEN u.key IS NOT NULL THEN 'bikepoint_number' ELSE 'terminal_name' END
                WHEN m.ordinal IS NOT NULL THEN 'common_name' END AS match_method,
           s.ordinal, s.bikepoint_id, s.common_name, s.terminal_name, s.lat, s.lon
    FROM named n
    LEFT JOIN id_lookup i ON i.key = {numeric_key("n.station_id")}
    LEFT JOIN number_keys u ON u.key = i.key
    LEFT JOIN name_lookup m ON m.key = {name_key("n.station_name")}
    LEFT JOIN stations s ON s.ordinal = coalesce(i.ordinal, m.ordinal)""",
    "playback": "SELECT cast(start_at AS DATE) AS day, * FROM trips WHERE end_station_name IS NOT NULL",
    "located": """
    SELECT p.*, a.bikepoint_id AS start_bikepoint_id, a.lat AS start_lat, a.lon AS start_lon, a.match_method AS start_match_method,
           b.bikepoint_id AS end_bikepoint_id, b.lat AS end_lat, b.lon AS end_lon, b.match_method AS end_match_method
    FROM playback p
    LEFT JOIN matches a ON a.station_id IS NOT DISTINCT FROM p.start_station_id AND a.station_name = p.start_station_name
    LEFT JOIN matches b ON b.station_id IS NOT DISTINCT FROM p.end_station_id AND b.station_name = p.end_station_name""",
    "matched": "SELECT * FROM located WHERE start_lat IS NOT NULL AND start_lon IS NOT NULL AND end_lat IS NOT NULL AND end_lon IS NOT NULL",
    "route_pairs": """
    SELECT k, j, k * 11 + j AS ordinal, least('BikePoints_' || k, 'BikePoints_' || far) AS pair_from,
           greatest('BikePoints_' || k, 'BikePoints_' || far) AS pair_to,
           CASE WHEN 'BikePoints_' || k < 'BikePoints_' || far THEN k ELSE far END AS a,
           CASE WHEN 'BikePoints_' || k < 'BikePoints_' || far THEN far ELSE k END AS b
    FROM (SELECT s_suppkey AS k, j, s_suppkey // 2 + j AS far FROM supplier, (SELECT unnest(range(0, 11)) AS j)) WHERE k <> far""",
    "cache_a": _cache(2),
    "cache_b": _cache(3),
    "loaded": _loaded("cache_a", 0) + " UNION ALL " + _loaded("cache_b", 1),
    "routes": """
    SELECT route_key, min(place) AS place, arg_max(pair_from, place) AS pair_from, arg_max(pair_to, place) AS pair_to,
           arg_max(coordinates, place) AS coordinates, arg_max(trip_count, place) AS trip_count,
           arg_max(distance_meters, place) AS distance_meters
    FROM loaded GROUP BY route_key""",
    "routed": """
    SELECT m.*, r.route_key, r.distance_meters AS route_distance_meters,
           coalesce(r.route_key IS NOT NULL AND m.start_bikepoint_id > m.end_bikepoint_id, false) AS route_reversed
    FROM located m LEFT JOIN routes r
      ON m.start_bikepoint_id <> m.end_bikepoint_id
     AND r.route_key = least(m.start_bikepoint_id, m.end_bikepoint_id) || '|' || greatest(m.start_bikepoint_id, m.end_bikepoint_id)""",
    "replay": f"""
    SELECT *, coalesce(start_station_id, '') || chr(31) || start_station_name AS start_station_key,
           coalesce(end_station_id, '') || chr(31) || end_station_name AS end_station_key,
           CASE WHEN ended < start_second THEN start_second + duration_seconds ELSE ended END AS end_second
    FROM (SELECT *, {second("start_at")} AS start_second, {second("end_at")} AS ended FROM routed
          WHERE start_lat IS NOT NULL AND start_lon IS NOT NULL AND end_lat IS NOT NULL AND end_lon IS NOT NULL)""",
    "ends": """
    SELECT day, start_station_id AS station_id, start_station_name AS station_name, 1 AS dep, 0 AS arr FROM playback
    UNION ALL SELECT day, end_station_id, end_station_name, 0, 1 FROM playback""",
    "ranked": """
    SELECT pair_from, pair_to, cast(count(*) AS BIGINT) AS trips FROM (
      SELECT least(a.bikepoint_id, b.bikepoint_id) AS pair_from, greatest(a.bikepoint_id, b.bikepoint_id) AS pair_to
      FROM trips t
      JOIN matches a ON a.station_id IS NOT DISTINCT FROM t.start_station_id AND a.station_name IS NOT DISTINCT FROM t.start_station_name
      JOIN matches b ON b.station_id IS NOT DISTINCT FROM t.end_station_id AND b.station_name IS NOT DISTINCT FROM t.end_station_name
      WHERE a.bikepoint_id <> b.bikepoint_id) GROUP BY ALL""",
    "raw": f"""
    SELECT event_id, event_id % 5 AS layout, '  ' || journey_id || chr(9) AS journey_id, bike_id, bike_model,
           {{start}} AS start_text, {{end}} AS end_text, start_station_id, start_station_name || ' ' AS start_station_name,
           end_station_id, end_station_name,
           CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '12.5'
                ELSE cast(CASE WHEN event_id % 5 = 4 THEN duration_ms ELSE duration_seconds END AS VARCHAR) END AS duration,
           source_key, source_etag, source_row_number
    FROM trips""",
}


def _stamp(at: str) -> str:
    return (
        "CASE WHEN event_id % 71 = 0 THEN 'n/a' "
        f"WHEN event_id % 5 = 4 AND event_id % 3 = 0 THEN ' ' || strftime({at}, '%Y-%m-%d %H:%M') || '  ' "
        f"WHEN event_id % 5 <> 4 AND event_id % 3 = 2 THEN strftime({at}, '%Y-%m-%d %H:%M:%S') "
        f"WHEN (event_id % 5 = 4 AND event_id % 3 = 1) OR (event_id % 5 <> 4 AND event_id % 3 = 0) "
        f"THEN strftime({at}, '%d/%m/%Y %H:%M') ELSE strftime({at}, '%d/%m/%Y %H:%M:%S') END"
    )


def _parsed(text: str) -> str:
    trimmed = f"trim({text})"
    return (
        f"coalesce(try_strptime({text}, '%Y-%m-%d %H:%M:%S'), "
        f"CASE WHEN layout = 4 THEN try_strptime({trimmed}, '%Y-%m-%d %H:%M') END, "
        f"try_strptime({trimmed}, '%d/%m/%Y %H:%M'), "
        f"CASE WHEN layout <> 4 THEN try_strptime({trimmed}, '%d/%m/%Y %H:%M:%S') END)"
    )


CTES["raw"] = CTES["raw"].format(start=_stamp("start_at"), end=_stamp("end_at"))
CTES["raw_parsed"] = f"""
    SELECT *, {_parsed("start_text")} AS start_at, {_parsed("end_text")} AS end_at,
           CASE WHEN regexp_full_match(duration, '[+-]?[0-9]+') THEN cast(duration AS BIGINT) END AS source_duration FROM raw"""
CTES["normalized"] = """
    SELECT trim(journey_id, ' ' || chr(9)) AS journey_id, bike_id, CASE WHEN layout = 4 THEN bike_model END AS bike_model,
           start_at, end_at, start_station_id, trim(start_station_name) AS start_station_name,
           CASE WHEN layout <> 3 THEN end_station_id END AS end_station_id, end_station_name,
           CASE WHEN layout = 4 THEN cast(floor(coalesce(source_duration, measured) / 1000) AS BIGINT)
                ELSE coalesce(source_duration, cast(floor(measured / 1000) AS BIGINT)) END AS duration_seconds,
           CASE WHEN layout = 4 THEN coalesce(source_duration, measured) ELSE coalesce(source_duration * 1000, measured) END AS duration_ms,
           source_key, source_etag, source_row_number
    FROM (SELECT *, date_diff('millisecond', start_at, end_at) AS measured FROM raw_parsed)"""
CTES["dirty"] = """
    SELECT CASE WHEN event_id % 61 = 0 THEN 'repeated' ELSE journey_id END AS journey_id,
           CASE WHEN event_id % 50 <> 0 THEN bike_id END AS bike_id, bike_model,
           CASE WHEN event_id % 53 = 0 THEN end_at ELSE start_at END AS start_at,
           CASE WHEN event_id % 53 = 0 THEN start_at WHEN event_id % 71 = 0 THEN start_at + INTERVAL 15 DAY ELSE end_at END AS end_at,
           start_station_id, CASE WHEN event_id % 67 = 0 THEN '' ELSE start_station_name END AS start_station_name,
           end_station_id, end_station_name,
           CASE WHEN event_id % 59 = 0 THEN duration_seconds + 300 WHEN event_id % 71 = 0 THEN 1296000 ELSE duration_seconds END AS duration_seconds,
           CASE WHEN event_id % 83 = 0 THEN 'n/a' WHEN event_id % 71 = 0 THEN '1296000000' ELSE cast(duration_ms AS VARCHAR) END AS ms_text,
           source_key, source_etag, CASE WHEN event_id % 79 = 0 THEN 0 ELSE source_row_number END AS source_row_number, event_id
    FROM trips"""
CTES["flagged"] = """
    SELECT *, list_filter([
      CASE WHEN count(*) OVER (PARTITION BY source_key, journey_id) > 1 THEN 'primary_key' END,
      CASE WHEN bike_id IS NULL THEN 'bike_id|nullability' END,
      CASE WHEN end_station_name IS NULL THEN 'end_station_name|nullability' END,
      CASE WHEN length(start_station_name) < 1 THEN 'start_station_name|min_length' END,
      CASE WHEN end_at < start_at THEN 'end_not_before_start' END,
      CASE WHEN NOT (duration_ms >= duration_seconds * 1000 AND duration_ms < (duration_seconds + 1) * 1000) THEN 'duration_units_agree' END,
      CASE WHEN abs(duration_ms - (epoch_us(end_at) - epoch_us(start_at)) // 1000) > 120000 THEN 'duration_matches_timestamps' END,
      CASE WHEN duration_ms > 1209600000 THEN 'plausible_duration' END,
      CASE WHEN source_row_number < 1 THEN 'source_row_number|min' END,
      CASE WHEN ms_text IS NOT NULL AND duration_ms IS NULL THEN 'duration_ms|dtype' END,
      CASE WHEN duration_ms IS NULL THEN 'duration_ms|nullability' END], lambda r: r IS NOT NULL) AS failed
    FROM (SELECT *, try_cast(ms_text AS BIGINT) AS duration_ms FROM dirty)"""
CTES["listing"] = """
    SELECT 'files/' || o_orderkey || '.csv' AS source_key,
           CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE cast(floor(o_totalprice) AS BIGINT) END AS size_bytes,
           strftime(o_orderdate, '%Y-%m-%d') AS last_modified, o_orderpriority AS etag, o_orderkey AS position FROM orders"""
CTES["ledger"] = """
    SELECT source_key, 'u/' || source_key AS source_url, etag, size_bytes, last_modified, 'raw/' || source_key AS raw_path,
           CASE WHEN k % 4 = 1 THEN 'n/' || source_key END AS normalized_path, raw_status, normalized_status, validated_status,
           CASE WHEN k % 4 = 1 THEN k % 1000 END AS row_count_raw, CASE WHEN k % 4 = 1 THEN 'trips_v1' END AS schema_version,
           CASE WHEN k % 4 = 2 THEN 'bad' END AS error_message, k
    FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN 'gone/' ELSE 'files/' END || o_orderkey || '.csv' AS source_key,
                 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS etag,
                 cast(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size_bytes,
                 strftime(o_orderdate, '%Y-%m-%d') AS last_modified,
                 CASE WHEN o_orderkey % 4 <> 0 THEN 'downloaded' ELSE 'failed' END AS raw_status,
                 CASE WHEN o_orderkey % 4 = 1 THEN 'normalized' WHEN o_orderkey % 4 = 2 THEN 'failed'
                      WHEN o_orderkey % 8 = 3 THEN 'skipped' ELSE 'pending' END AS normalized_status,
                 CASE WHEN o_orderkey % 8 = 1 THEN 'validated' WHEN o_orderkey % 16 = 5 THEN 'failed' ELSE 'pending' END AS validated_status
          FROM orders WHERE o_orderkey % 5 <> 0)"""


# Routes are packed in order, a shard closing before the route that would overfill it.
CTES["route_sizes"] = """
    SELECT row_number() OVER (ORDER BY place) AS n, place, route_key, length(cast(to_json(map {route_key: coordinates}) AS VARCHAR)) AS route_bytes FROM routes"""
CTES["packed_routes"] = """
    SELECT z.place, z.route_key, z.route_bytes, 'shard-' || lpad(cast(w.shard AS VARCHAR), 4, '0') AS shard_id FROM route_sizes z JOIN
      (WITH RECURSIVE walk AS (SELECT n, route_bytes AS held, 0 AS shard FROM route_sizes WHERE n = 1
         UNION ALL SELECT z.n, CASE WHEN w.held + z.route_bytes > 4000 THEN z.route_bytes ELSE w.held + z.route_bytes END,
           CASE WHEN w.held + z.route_bytes > 4000 THEN w.shard + 1 ELSE w.shard END
           FROM walk w JOIN route_sizes z ON z.n = w.n + 1) SELECT n, shard FROM walk) w ON w.n = z.n"""


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the tables it names, in order, and those they name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if word in CTES and word not in needed:
                visit(CTES[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in needed)
    return f"WITH {parts}\n{sql.strip()}"
