"""State at a clock time, from replay trips (see ``replay.replay_trips``).

Clock times are seconds of the day and come as a short list; every operator
answers all of them, for every day, in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.functions.clock import LAST_SECOND
from velospan.functions.geometry import arc_path, line_path, path_window
from velospan.functions.text import station_key

# Seconds an event stays visible, share of the peak that counts as active.
EVENT_SECONDS = 90
ACTIVE_SHARE = 0.02


def _clocks(times: Sequence[int]) -> Column:
    if not times:
        raise ValueError("at least one clock time is needed")
    return F.lit(sorted({int(t) for t in times})).cast("array<bigint>")


def _first_at_or_after(times: Sequence[int], second: Column) -> Column:
    """The first clock time that is not before ``second``; null after the last one."""
    return F.get(F.filter(_clocks(times), lambda t: t >= second), 0)


def _at_every_clock(per_clock: DataFrame, keys: list[str], times: Sequence[int]) -> DataFrame:
    """Rows of (keys, clock, values) widened to every clock time, zero where there were none.

    Values are gathered into one map per key, as long as the clock list, so the
    keys and their values come from one pass over the trips.
    """
    values = [c for c in per_clock.columns if c not in (*keys, "clock")]
    entry = F.when(F.col("clock").isNotNull(), F.struct("clock", F.struct(*values).alias("values")))
    by_key = per_clock.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("clocks"))
    grid = by_key.select(*keys, "clocks", F.explode(_clocks(times)).alias("clock"))
    found = grid.select(*keys, "clock", F.try_element_at("clocks", "clock").alias("at"))
    return found.select(*keys, "clock", *[F.coalesce(F.col(f"at.{v}"), F.lit(0)).alias(v) for v in values])


def _running(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("clock").rowsBetween(W.unboundedPreceding, W.currentRow)


def _span() -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.col("end_second") - F.col("start_second"))


def progress(clock: Column) -> Column:
    return (clock - F.col("start_second")) / _span()


def active_at(replay: DataFrame, times: Sequence[int], routed_only: bool = False) -> DataFrame:
    """Trips under way at each clock time, both ends included, with ``clock``."""
    start, end = F.col("start_second"), F.col("end_second")
    trips = replay.filter(F.col("route_key").isNotNull()) if routed_only else replay
    times = sorted({int(t) for t in times})
    # Trips outside the first and last clock time are dropped before the row is widened.
    reach = trips.filter((start <= times[-1]) & (end >= times[0])) if times else trips
    under_way = F.filter(_clocks(times), lambda t: (t >= start) & (t <= end))
    return reach.select("*", F.explode(under_way).alias("clock"))


def running_totals(replay: DataFrame, times: Sequence[int]) -> DataFrame:
    """Journeys so far, routed and unrouted, routed kilometres, and trips under way, per day and clock.

    Each trip sends one row to the first clock at or after its start, one to the
    first at or after its end with the whole distance, and one per clock it is
    under way at with the part ridden; sums per (day, clock) are taken map-side.
    """
    routed = F.col("route_key").isNotNull().cast("int")
    metres = F.coalesce("route_distance_meters", F.lit(0.0))
    start, end = F.col("start_second"), F.col("end_second")
    done = start + _span()
    none, nothing = F.lit(0), F.lit(0.0)

    def row(clock, journeys=none, routes=none, whole=nothing, active=none, active_routes=none, part=nothing) -> Column:
        return F.struct(
            clock.alias("clock"),
            journeys.alias("journeys"),
            routes.alias("routed"),
            whole.alias("whole"),
            active.alias("active"),
            active_routes.alias("active_routed"),
            part.alias("part"),
        )

    def riding(t: Column) -> Column:
        part = F.when(t < done, metres * (t - start) / _span()).otherwise(nothing)
        return row(t, active=F.lit(1), active_routes=routed, part=part)

    begins = row(_first_at_or_after(times, start), journeys=F.lit(1), routes=routed)
    ends = row(_first_at_or_after(times, done), whole=metres)
    under_way = F.transform(F.filter(_clocks(times), lambda t: (t >= start) & (t <= end)), riding)
    per_clock = (
        replay.select("day", F.inline(F.concat(F.array(begins, ends), under_way)))
        .groupBy("day", "clock")
        .agg(*[F.sum(name).alias(name) for name in ("journeys", "routed", "whole", "active", "active_routed", "part")])
    )
    full = _at_every_clock(per_clock, ["day"], times)
    so_far = _running(["day"])
    journeys, routed_so_far = F.sum("journeys").over(so_far), F.sum("routed").over(so_far)
    return full.select(
        "day",
        "clock",
        journeys.alias("journeys"),
        routed_so_far.alias("routed_journeys"),
        (journeys - routed_so_far).alias("unrouted_journeys"),
        ((F.sum("whole").over(so_far) + F.col("part")) / 1000).alias("routed_kilometres"),
        F.col("active").alias("active_trips"),
        F.col("active_routed").alias("active_routed_trips"),
        (F.col("active") - F.col("active_routed")).alias("active_unrouted_trips"),
    )


def _station_events(replay: DataFrame) -> DataFrame:
    """(day, station_key, second, departures, arrivals) rows, two per trip from one scan."""
    events = F.array(
        *[
            F.struct(
                F.col(f"{side}_station_key").alias("station_key"),
                F.col(f"{side}_second").alias("second"),
                F.lit(leaves).alias("departures"),
                F.lit(1 - leaves).alias("arrivals"),
            )
            for side, leaves in (("start", 1), ("end", 0))
        ]
    )
    return replay.select("day", F.inline(events))


def station_balance(replay: DataFrame, times: Sequence[int], drawn: DataFrame | None = None) -> DataFrame:
    """Departures, arrivals and net per day and station up to each clock time.

    With ``drawn`` (``day`` and ``id``, as ``station_records`` gives them) every drawn
    station has its rows, of zeros while nothing happened there.
    """
    keys = ["day", "station_key"]
    events = _station_events(replay)
    if drawn is not None:
        idle = [F.lit(times[0] if len(times) else 0).alias("second"), *[F.lit(0).alias(c) for c in ("departures", "arrivals")]]
        events = events.unionByName(drawn.select("day", F.col("id").alias("station_key"), *idle))
    counted = (
        events.select(*keys, _first_at_or_after(times, F.col("second")).alias("clock"), "departures", "arrivals")
        .groupBy(*keys, "clock")
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
    )
    full = _at_every_clock(counted, keys, times)
    so_far = _running(keys)
    left, came = F.sum("departures").over(so_far), F.sum("arrivals").over(so_far)
    return full.select(*keys, "clock", left.alias("departures"), came.alias("arrivals"), (came - left).alias("net"))


def balance_timeline(replay: DataFrame) -> DataFrame:
    """The station balance after every second in which it changes.

    Events are first summed per second, so the running sum sees at most one row
    per second and station however busy the station is.
    """
    keys = ["day", "station_key"]
    per_second = (
        _station_events(replay)
        .groupBy(*keys, "second")
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
        .withColumnRenamed("second", "clock")
    )
    so_far = _running(keys)
    left, came = F.sum("departures").over(so_far), F.sum("arrivals").over(so_far)
    return per_second.select(
        *keys, "clock", left.alias("departures"), came.alias("arrivals"), (came - left).alias("net")
    )


def recent_events(replay: DataFrame, times: Sequence[int], seconds: int = EVENT_SECONDS) -> DataFrame:
    """Departures and arrivals in the last ``seconds`` before each clock time, with their age."""
    sides = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(f"{side}_second").alias("second"),
                F.col(f"{side}_lon").alias("lon"),
                F.col(f"{side}_lat").alias("lat"),
            )
            for side, kind in (("start", "departure"), ("end", "arrival"))
        ]
    )
    second = F.col("second")
    shown = F.filter(_clocks(times), lambda t: (second <= t) & (second >= t - seconds))
    return (
        replay.select("day", "journey_id", F.inline(sides))
        .select("*", F.explode(shown).alias("clock"))
        .select(
            "day",
            "clock",
            F.concat("journey_id", F.lit("-"), "kind").alias("id"),
            "kind",
            F.array("lon", "lat").alias("coord"),
            (F.col("clock") - second).alias("age"),
        )
    )


def station_filter(replay: DataFrame, selected: DataFrame) -> DataFrame:
    """Trips that start or end at a station of ``selected`` (station_id, station_name).

    Two equi-joins with the distinct selection, one per end: an either-end
    condition in a single semi join could only run as a nested loop.
    """
    keys = selected.select(station_key("station_id", "station_name").alias("key")).distinct()
    joined = replay
    for side in ("start", "end"):
        chosen = keys.select(F.col("key").alias(f"{side}_station_key"), F.lit(True).alias(f"_{side}_chosen"))
        joined = joined.join(chosen, f"{side}_station_key", "left")
    touched = joined.filter(F.col("_start_chosen").isNotNull() | F.col("_end_chosen").isNotNull())
    return touched.select(*replay.columns)


_TRACE_COLUMNS = ["start_lon", "start_lat", "end_lon", "end_lat", "route_key", "route_reversed"]


def trip_traces(replay: DataFrame, routes: DataFrame, times: Sequence[int], window: float) -> DataFrame:
    """The path piece behind every trip under way at each clock time.

    ``routes`` gives (route_key, coordinates), one row per key; a trip without a
    route follows an arc between its ends. ``window`` is the length of the piece
    as a share of the path; its last point is the trip's head.
    """
    # Routes are joined once per trip: clock copies of a busy pair's trips are not shuffled.
    trips = replay.select("day", "journey_id", "start_second", "end_second", *_TRACE_COLUMNS)
    routed = trips.join(routes.select("route_key", "coordinates"), "route_key", "left")
    drawn = active_at(routed, times).select("*", progress(F.col("clock")).alias("progress"))
    line = line_path(F.col("coordinates"), F.col("route_reversed"))
    arc = arc_path(F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat"))
    pieces = [path_window(path, F.col("progress"), window) for path in (line, arc)]
    return drawn.select(
        "day",
        "clock",
        "journey_id",
        "progress",
        F.col("route_key").isNotNull().alias("routed"),
        F.when(F.col("coordinates").isNotNull(), pieces[0]).otherwise(pieces[1]).alias("path"),
    ).withColumn("head", F.element_at("path", -1))


def required_routes(replay: DataFrame) -> DataFrame:
    """The distinct shards and route keys the trips of a day need."""
    routed = replay.filter(F.col("route_key").isNotNull())
    return routed.select("day", "route_shard", "route_key").distinct()


def activity_domain(activity: DataFrame, share: float = ACTIVE_SHARE) -> DataFrame:
    """First and last bin of a day whose count reaches ``share`` of its peak; else the whole day."""
    by_day = W.partitionBy("day")
    peak = F.greatest(F.lit(1).cast("bigint"), F.max("active_trips").over(by_day))
    floor = F.greatest(F.lit(1).cast("bigint"), F.floor(peak * F.lit(share)))
    busy = activity.select("day", F.when(F.col("active_trips") >= floor, F.col("time")).alias("time"))
    ends = busy.groupBy("day").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    spread = F.col("last") > F.col("first")
    return ends.select(
        "day",
        F.when(spread, F.col("first")).otherwise(F.lit(0)).alias("domain_start"),
        F.when(spread, F.col("last")).otherwise(F.lit(LAST_SECOND)).alias("domain_end"),
    )


def volume_histogram(days: DataFrame) -> DataFrame:
    """Bars of (day, trips): share of the busiest day, calendar boundaries, labels."""
    peak = F.greatest(F.lit(1).cast("bigint"), days.agg(F.max("trips")).scalar())
    day = F.col("day")
    return days.select(
        "day",
        "trips",
        (F.col("trips") / peak).alias("share"),
        (F.dayofweek(day) == 2).alias("is_monday"),
        (F.dayofmonth(day) == 1).alias("is_month_start"),
        (F.dayofyear(day) == 1).alias("is_year_start"),
        F.concat(F.lit("w/c "), F.dayofmonth(day), F.lit(" "), F.date_format(day, "MMM")).alias("week_label"),
        F.date_format(day, "MMM yyyy").alias("month_label"),
        F.date_format(day, "yyyy").alias("year_label"),
        F.date_format(day, "EEEE").alias("weekday"),
    )
