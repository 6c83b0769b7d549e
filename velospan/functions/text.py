"""Text cleaning and the keys stations are matched on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velospan.schemas import KEY_SEPARATOR

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Text without white space at either end; empty text stays empty."""
    return F.btrim(_col(value).cast("string"), F.lit(WHITESPACE))


def text_or_null(value: Column | str) -> Column:
    """Cleaned text, with nothing left turned into null."""
    return _filled(clean_text(value))


def has_text(value: Column | str) -> Column:
    """Whether anything but white space is there."""
    return _col(value).rlike(r"(?U)\S")


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def digits(value: Column | str) -> Column:
    """``numeric_key`` with empty text instead of null, in one replacement."""
    return F.regexp_replace(_col(value), r"(?U)^[\D0]+(?=\d)|\D+", "")


def words(value: Column | str) -> Column:
    """``name_key`` with empty text instead of null."""
    return F.trim(F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]+", " "))


def numeric_key(value: Column | str) -> Column:
    """The digits of a station number without leading zeros; null when it has none."""
    return _filled(digits(value))


def name_key(value: Column | str) -> Column:
    """Lower-case letters and digits with single spaces between runs; null when nothing is left."""
    return _filled(words(value))


def station_key(station_id: Column | str, station_name: Column | str) -> Column:
    """One text for a station as a trip names it, null-safe in both parts."""
    empty = F.lit("")
    return F.concat(F.coalesce(_col(station_id), empty), F.lit(KEY_SEPARATOR), F.coalesce(_col(station_name), empty))
