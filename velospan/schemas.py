"""Table layouts: the canonical trip, the file ledger, stations and routes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    """``name type`` per line; a trailing ``!`` marks a required column."""
    fields = []
    for line in text.strip().splitlines():
        name, kind = line.split()
        required = kind.endswith("!")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not required))
    return T.StructType(fields)


# Column names, order and types of the published tables.
TRIP = _struct("""
    journey_id          string!
    bike_id             string!
    bike_model          string
    start_at            timestamp_ntz!
    end_at              timestamp_ntz!
    start_station_id    string!
    start_station_name  string!
    end_station_id      string
    end_station_name    string!
    duration_seconds    bigint!
    duration_ms         bigint!
    source_key          string!
    source_etag         string!
    source_member       string
    source_row_number   bigint!
""")

LEDGER = _struct("""
    source_key            string!
    source_url            string!
    etag                  string
    size_bytes            bigint!
    last_modified         string!
    raw_path              string
    normalized_path       string
    validated_path        string
    invalid_path          string
    raw_status            string!
    normalized_status     string!
    validated_status      string!
    row_count_raw         bigint
    row_count_normalized  bigint
    row_count_validated   bigint
    row_count_invalid     bigint
    schema_version        string
    error_message         string
    discovered_at         string!
    raw_downloaded_at     string
    processed_at          string
""")

ROUTE_CACHE = _struct("""
    pair_from         string!
    pair_to           string!
    from_name         string
    to_name           string
    from_coord        string
    to_coord          string
    trip_count        bigint
    distance_meters   double
    duration          string
    duration_seconds  double
    static_duration   string
    weight            double
    weight_name       string
    geometry          string
    code              string
    uuid              string
    error             string
""")

#: A document of an export: what it is, where its files lie, what it counts, and what a day was made of.
EXPORT_ENTRY = _struct("""
    kind                  string!
    id                    string!
    part                  bigint!
    path                  string!
    hash                  string!
    bytes                 bigint!
    gzip_bytes            bigint!
    trips_in_slice        bigint
    routed_in_slice       bigint
    routes_in_shard       bigint
    stations_in_document  bigint
    input                 string
""")

SCHEMA_VERSION = "trips_v1"
STATION_ID_PREFIX = "BikePoints_"
KEY_SEPARATOR = "\u001f"
# End of fixed values.

TRIP_COLUMNS = TRIP.fieldNames()
LEDGER_COLUMNS = LEDGER.fieldNames()


def nullable(schema: T.StructType) -> T.StructType:
    """The same columns with every one optional, as files are read."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


@dataclass(frozen=True)
class Layout:
    """One historical trip file layout: canonical column -> header name."""

    name: str
    headers: dict[str, str]
    day_first: str
    duration_unit: str

    @property
    def required(self) -> list[str]:
        return list(self.headers.values())


# The five published layouts in the order they are tried, with the
# day-first datetime shape each one allows besides ISO text.
_DAY_FIRST_MINUTES = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2})$"
_DAY_FIRST_SECONDS = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2}(?::\d{1,2})?)$"
_CLASSIC = {
    "journey_id": "Rental Id",
    "bike_id": "Bike Id",
    "start_at": "Start Date",
    "end_at": "End Date",
    "start_station_id": "StartStation Id",
    "start_station_name": "StartStation Name",
    "end_station_id": "EndStation Id",
    "end_station_name": "EndStation Name",
    "duration": "Duration",
}
LAYOUTS = [
    Layout("old", _CLASSIC, _DAY_FIRST_SECONDS, "s"),
    Layout(
        "old_logical_terminal",
        _CLASSIC
        | {
            "start_station_id": "StartStation Logical Terminal",
            "end_station_id": "EndStation Logical Terminal",
        },
        _DAY_FIRST_SECONDS,
        "s",
    ),
    Layout(
        "old_spaced_station_columns",
        _CLASSIC
        | {
            "start_station_id": "Start Station Id",
            "start_station_name": "Start Station Name",
            "end_station_id": "End Station Id",
            "end_station_name": "End Station Name",
            "duration": "Duration_Seconds",
        },
        _DAY_FIRST_SECONDS,
        "s",
    ),
    Layout(
        "old_missing_end_station_id",
        {column: header for column, header in _CLASSIC.items() if column != "end_station_id"},
        _DAY_FIRST_SECONDS,
        "s",
    ),
    Layout(
        "new",
        {
            "journey_id": "Number",
            "bike_id": "Bike number",
            "bike_model": "Bike model",
            "start_at": "Start date",
            "end_at": "End date",
            "start_station_id": "Start station number",
            "start_station_name": "Start station",
            "end_station_id": "End station number",
            "end_station_name": "End station",
            "duration": "Total duration (ms)",
        },
        _DAY_FIRST_MINUTES,
        "ms",
    ),
]
# End of fixed values.
