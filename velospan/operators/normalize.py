"""Raw trip rows of any published layout -> the canonical trip table.

A raw row is positional: ``header`` and ``fields`` are arrays of text, so files
of every layout flow through one plan and no read depends on column order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velospan.functions.clock import floor_seconds, millis_between, parse_datetime, turn_day_first, whole_number
from velospan.functions.text import clean_text
from velospan.schemas import LAYOUTS, TRIP_COLUMNS, Layout

_TEXTS = [
    "journey_id",
    "bike_id",
    "bike_model",
    "start_station_id",
    "start_station_name",
    "end_station_id",
    "end_station_name",
]
_COLUMNS = [*_TEXTS, "start_at", "end_at", "duration"]


def detect_layout(header: Column) -> Column:
    """Name of the first layout whose columns are all in ``header``; null if none fits."""

    def fits(layout: Layout) -> Column:
        return F.forall(F.lit(layout.required), lambda name: F.array_contains(header, name))

    return F.coalesce(*[F.when(fits(layout), F.lit(layout.name)) for layout in LAYOUTS])


def unknown_layout_message(header: Column) -> Column:
    return F.concat(F.lit("no layout has these columns: "), F.array_join(header, ", ", "null"))


def with_layout(rows: DataFrame) -> DataFrame:
    """Replace ``header`` by ``layout`` and ``places``, where each canonical column stands.

    It costs the same for a table of headers as for one row of many; the readers give
    every row its header, and ``normalize_trips`` resolves it there.
    """
    named = rows.select("*", detect_layout(F.col("header")).alias("layout"))
    names = [F.lit([layout.headers.get(column, "") for column in _COLUMNS]) for layout in LAYOUTS]
    chain = F.when(F.col("layout") == LAYOUTS[0].name, names[0])
    for layout, list_of_names in zip(LAYOUTS[1:], names[1:]):
        chain = chain.when(F.col("layout") == layout.name, list_of_names)
    # A column the layout lacks has no name; a blank header cell is not that column.
    places = F.transform(chain, lambda name: F.when(name == "", 0).otherwise(F.array_position("header", name)).cast("int"))
    return named.select("*", places.alias("places")).drop("header")


def _per_layout(values: dict[str, Any], build: Callable[[Any], Column]) -> Column:
    """``build`` of the row's layout's value; layouts that share a value share a branch."""
    groups: dict[Any, list[str]] = {}
    for name, value in values.items():
        groups.setdefault(value, []).append(name)
    (value, names), *rest = groups.items()
    chain = F.when(F.col("layout").isin(names), build(value))
    for value, names in rest:
        chain = chain.when(F.col("layout").isin(names), build(value))
    return chain


def repair_duration(source: Column, unit: Column, measured: Column) -> tuple[Column, Column]:
    """(seconds, milliseconds): the source value where it is a number, else the measured milliseconds."""
    millis = F.coalesce(source, measured)
    as_millis = F.coalesce(F.try_multiply(source, F.lit(1000).cast("bigint")), measured)
    seconds = F.when(unit == "ms", floor_seconds(millis)).otherwise(F.coalesce(source, floor_seconds(measured)))
    return seconds, F.when(unit == "ms", millis).otherwise(as_millis)


def normalize_trips(rows: DataFrame) -> DataFrame:
    """Canonical trips from (layout, places, fields, source_key, source_etag, source_member,
    source_row_number) rows; a ``header`` instead of layout and places is resolved here.

    Rows of an unknown layout have no canonical form and are not returned;
    ``detect_layout`` on the header tells which files those are. The steps below
    pass on only what the next one uses, so that each compiles to a method of its own.
    """
    if "layout" not in rows.columns:
        rows = with_layout(rows)
    provenance = TRIP_COLUMNS[-4:]
    found = rows.filter(F.col("layout").isNotNull()).select(
        "layout", *provenance, F.transform("places", lambda place: F.get("fields", place - 1)).alias("raw")
    )
    raw = {column: F.get("raw", number) for number, column in enumerate(_COLUMNS)}
    picked = found.select(
        "layout",
        *provenance,
        *[clean_text(raw[column]).alias(column) for column in _TEXTS],
        raw["start_at"].alias("start_at"),
        raw["end_at"].alias("end_at"),
        whole_number(raw["duration"]).alias("duration"),
    )
    kept = [*provenance, *_TEXTS]
    shapes = {l.name: l.day_first for l in LAYOUTS}
    times = ("start_at", "end_at")
    stripped = picked.select("layout", *kept, "duration", *times, *[clean_text(c).alias(f"{c}_text") for c in times])

    def turned(column: str) -> Column:
        return _per_layout(shapes, lambda shape: turn_day_first(F.col(f"{column}_text"), shape)).alias(f"{column}_turned")

    both = stripped.select(
        *kept,
        "duration",
        *times,
        *[f"{c}_text" for c in times],
        *[turned(c) for c in times],
        _per_layout({l.name: l.duration_unit for l in LAYOUTS}, F.lit).alias("unit"),
    )
    timed = both.select(
        *kept,
        "duration",
        "unit",
        *[parse_datetime(F.col(c), F.col(f"{c}_text"), F.col(f"{c}_turned")).alias(c) for c in times],
    )
    measured = timed.select(*timed.columns, millis_between(F.col("start_at"), F.col("end_at")).alias("measured"))
    seconds, millis = repair_duration(F.col("duration"), F.col("unit"), F.col("measured"))
    done = measured.select(*kept, *times, seconds.alias("duration_seconds"), millis.alias("duration_ms"))
    return done.select(*TRIP_COLUMNS)
