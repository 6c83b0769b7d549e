"""Clock arithmetic on zone-free timestamps.

Nothing here depends on the session time zone: fields are read from
``timestamp_ntz`` values and differences are taken in days and milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velospan.functions.text import clean_text

# A day in seconds, its last second and the activity bin width.
DAY_SECONDS = 86_400
LAST_SECOND = DAY_SECONDS - 1
BIN_SECONDS = 300

_ISO = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
_ISO_MINUTES = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"


def second_of_day(at: Column) -> Column:
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``."""

    def of_day(at: Column) -> Column:
        seconds = F.extract(F.lit("SECOND"), at)
        return (F.hour(at) * 3_600_000 + F.minute(at) * 60_000 + F.floor(seconds * 1000)).cast("bigint")

    days = F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")
    return days * (DAY_SECONDS * 1000) + of_day(end) - of_day(start)


def floor_seconds(millis: Column) -> Column:
    """``millis`` in seconds, rounded down (also below zero), in whole numbers."""
    return ((millis - F.pmod(millis, F.lit(1000))) / 1000).cast("bigint")


def playback_end(start: Column, end: Column, duration_seconds: Column) -> Column:
    """End second of the day; a trip that wraps midnight ends at start + duration."""
    begin, finish = second_of_day(start), second_of_day(end)
    return F.when(finish < begin, begin + duration_seconds).otherwise(finish).cast("bigint")


def parse_datetime(value: Column, text: Column, day_first: Column) -> Column:
    """ISO text, or day-first text turned year-first, as a zone-free timestamp.

    ``text`` is ``value`` without white space around it; ``day_first`` is
    ``turn_day_first(text, ...)``, which stays as it was when it has another shape.
    """

    def year_first(candidate: Column) -> Column:
        return F.substring(candidate, 5, 1) == "-"

    iso = F.when(value.rlike(_ISO), value).when(text.rlike(_ISO_MINUTES), text)
    return F.when(year_first(text), iso).when(year_first(day_first), day_first).try_cast("timestamp_ntz")


def turn_day_first(text: Column, shape: str) -> Column:
    return F.regexp_replace(text, shape, "$3-$2-$1 $4")


def whole_number(value: Column) -> Column:
    """A signed integer text as bigint; anything else is null."""
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value).try_cast("bigint")
