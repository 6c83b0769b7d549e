from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from velospan.functions.clock import (
    floor_seconds,
    millis_between,
    parse_datetime,
    playback_end,
    turn_day_first,
    whole_number,
)
from velospan.functions.geometry import arc_path, line_path, path_window
from velospan.functions.text import clean_text, name_key, numeric_key, station_key, text_or_null
from velospan.schemas import LAYOUTS

TEXTS = [None, "", " ", "0", "000", "0x0", "x0y", "00x05", "BikePoints_12", "001 02", "no digits", "٠٠٣", "7", "x00", "a1b0"]


def _number(text):
    digits = re.sub(r"\D+", "", text or "")
    return (digits.lstrip("0") or "0") if digits else None


def _name(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip() or None


def test_station_keys_follow_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = rows.select("i", numeric_key("t").alias("n"), name_key("t").alias("w")).orderBy("i").collect()
    assert [r.n for r in got] == [_number(t) for t in TEXTS]
    assert [r.w for r in got] == [_name(t) for t in TEXTS]


def test_clean_text_strips_all_white_space_and_keeps_empty(spark):
    rows = spark.createDataFrame([("\t a b　\xa0\n",), (" ",), (None,)], "t string")
    got = rows.select(clean_text("t").alias("c"), text_or_null("t").alias("n")).collect()
    assert [(r.c, r.n) for r in got] == [("a b", "a b"), ("", None), (None, None)]


def test_station_key_is_null_safe(spark):
    rows = spark.createDataFrame([("1", "A"), (None, "A"), (None, None)], "i string, n string")
    assert [r[0] for r in rows.select(station_key("i", "n")).collect()] == ["1\x1fA", "\x1fA", "\x1f"]


@pytest.mark.parametrize(
    ("layout", "text", "want"),
    [
        ("old", "01/02/2015 03:04", datetime(2015, 2, 1, 3, 4)),
        ("old", " 1/2/2015 3:04:05 ", datetime(2015, 2, 1, 3, 4, 5)),
        ("old", "2015-02-01 03:04:05", datetime(2015, 2, 1, 3, 4, 5)),
        ("new", "  2015-02-01 03:04 ", datetime(2015, 2, 1, 3, 4)),
        ("new", "01/02/2015 03:04", datetime(2015, 2, 1, 3, 4)),
        ("new", "01/02/2015 03:04:05", None),
        ("old", "31/02/2015 03:04", None),
        ("old", "2015-02", None),
        ("old", "2015", None),
        ("old", "", None),
        ("new", None, None),
    ],
)
def test_parse_datetime(spark, layout, text, want):
    shape = next(l.day_first for l in LAYOUTS if l.name == layout)
    rows = spark.createDataFrame([(text,)], "v string").withColumn("t", clean_text("v"))
    parsed = parse_datetime(F.col("v"), F.col("t"), turn_day_first(F.col("t"), shape))
    assert rows.select(parsed).first()[0] == want


def test_clock_arithmetic(spark):
    rows = spark.sql(
        "select timestamp_ntz'2024-03-31 23:59:50' a, timestamp_ntz'2024-04-01 00:00:10.250' b, -1500L m, 20L d"
    )
    got = rows.select(
        millis_between(F.col("a"), F.col("b")),
        millis_between(F.col("b"), F.col("a")),
        floor_seconds(F.col("m")),
        playback_end(F.col("a"), F.col("b"), F.col("d")),
        playback_end(F.col("b"), F.col("a"), F.col("d")),
    ).first()
    assert tuple(got) == (20250, -20250, -2, 86410, 86390)


def test_whole_number(spark):
    rows = spark.createDataFrame([("12",), ("-3",), ("12.0",), ("x",), ("99999999999999999999",), (None,)], "t string")
    assert [r[0] for r in rows.select(whole_number(F.col("t"))).collect()] == [12, -3, None, None, None, None]


def test_arc_has_no_bend_between_equal_places(spark):
    last, point = arc_path(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))
    got = spark.range(1).select(F.transform(F.sequence(F.lit(0), last), point)).first()[0]
    assert got == [[1.0, 2.0]] * 25


@pytest.mark.parametrize(
    ("path", "progress", "window", "want"),
    [
        ([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], 0.75, 0.5, [[0.5, 0.0], [1.0, 0.0], [1.5, 0.0]]),
        ([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], 1.0, 0.25, [[1.5, 0.0], [2.0, 0.0], [2.0, 0.0]]),
        ([[0.0, 0.0], [1.0, 0.0]], 0.0, 0.5, [[0.0, 0.0]]),
        ([[3.0, 4.0]], 0.5, 0.5, [[3.0, 4.0]]),
        ([], 0.5, 0.5, [[0.0, 0.0]]),
    ],
)
def test_path_window(spark, path, progress, window, want):
    rows = spark.createDataFrame([(path, progress)], "p array<array<double>>, s double")
    piece = path_window(line_path(F.col("p"), F.lit(False)), F.col("s"), window)
    assert rows.select(piece).first()[0] == want
    back = path_window(line_path(F.reverse("p"), F.lit(True)), F.col("s"), window)
    assert rows.select(back).first()[0] == want
