"""Pieces of paths, as ``array<array<double>>`` of ``[lon, lat]`` points.

A path is given by its last index and a function from an index to the point
there, so only the points that a piece needs are ever computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arc steps, largest bend in degrees and bend per degree of distance.
ARC_STEPS = 24
ARC_BEND = 0.012
ARC_BEND_SHARE = 0.22

Path = tuple[Column, Callable[[Column], Column]]


def line_path(points: Column, backwards: Column) -> Path:
    """Stored points, read from the end when ``backwards``; [0, 0] where there is no point."""
    last = F.size(points) - 1

    def point(index: Column) -> Column:
        found = F.get(points, F.when(backwards, last - index).otherwise(index))
        return F.coalesce(found, F.array(F.lit(0.0), F.lit(0.0)))

    return last, point


def arc_path(from_lon: Column, from_lat: Column, to_lon: Column, to_lat: Column) -> Path:
    """A curve of 25 points between two places; the same point throughout when they coincide."""
    dx, dy = to_lon - from_lon, to_lat - from_lat
    length = F.hypot(dx, dy)
    bend = F.least(F.lit(ARC_BEND), length * ARC_BEND_SHARE)
    apart = length > 0
    normal_x = F.when(apart, -dy / length).otherwise(0.0)
    normal_y = F.when(apart, dx / length).otherwise(0.0)

    def point(index: Column) -> Column:
        share = index / ARC_STEPS
        lift = F.sin(F.lit(math.pi) * share) * bend
        return F.array(from_lon + dx * share + normal_x * lift, from_lat + dy * share + normal_y * lift)

    return F.lit(ARC_STEPS), point


def _point_at(path: Path, share: Column) -> Column:
    """The point at ``share`` of the path, measured in vertices."""
    last, point = path
    scaled = share * last
    index = F.least(F.greatest(F.lit(0), F.floor(scaled).cast("int")), last)
    here, there = point(index), point(F.least(index + 1, last))
    partial = scaled - index

    def between(axis: int) -> Column:
        return F.get(here, axis) + (F.get(there, axis) - F.get(here, axis)) * partial

    on_vertex = (share <= 0) | (share >= 1) | (last < 1)
    return F.when(on_vertex, here).otherwise(F.array(between(0), between(1)))


def path_window(path: Path, progress: Column, window: float) -> Column:
    """The piece from ``progress - window`` to ``progress``, with both ends interpolated."""
    last, point = path
    stop = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    begin = F.greatest(F.lit(0.0), stop - window)
    first, final = F.floor(begin * last).cast("int"), F.floor(stop * last).cast("int")
    ends = F.array(_point_at(path, begin)), F.array(_point_at(path, stop))
    inner = F.transform(F.sequence(first + 1, F.greatest(final, first + 1)), point)
    piece = F.when(final > first, F.concat(ends[0], inner, ends[1])).otherwise(F.concat(*ends))
    standing = (last < 1) | (progress <= 0)
    return F.when(standing, F.array(point(F.lit(0)))).otherwise(piece)
