"""Cached routes: loading, provider precedence, joining to trips, shard packing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.operators.running import with_running_totals
from velospan.staging import staged

# Defaults of the shard size and its estimated compression.
SHARD_GZIP_BYTES = 1_500_000
SHARD_COMPRESSION = 6.0

_GEOMETRY = "struct<type: string, coordinates: array<array<double>>>"
_PLACE_BITS = 56
#: Targets of bytes in a span, and spans whose tables are merged at a time.
_SPAN_TARGETS, _FAN = 256, 64


def load_routes(cache: DataFrame) -> DataFrame:
    """Usable routes of one cache: no error, a geometry, at least one coordinate."""

    def given(column: str) -> Column:
        return F.col(column).isNotNull() & (F.col(column) != "null")

    parsed = cache.filter(~given("error") & given("geometry")).select(
        "ordinal",
        "pair_from",
        "pair_to",
        F.concat("pair_from", F.lit("|"), "pair_to").alias("route_key"),
        F.from_json("geometry", _GEOMETRY)["coordinates"].alias("coordinates"),
        F.coalesce("trip_count", F.lit(0).cast("bigint")).alias("trip_count"),
        "distance_meters",
    )
    return parsed.filter(F.size("coordinates") > 0)


def _ranked(providers: list[DataFrame]) -> DataFrame:
    """Rows of every provider with ``place``: provider first, then cache order."""
    ranked = [
        df.withColumn("place", F.lit(rank << _PLACE_BITS).cast("bigint") + F.col("ordinal"))
        for rank, df in enumerate(providers)
    ]
    whole = ranked[0]
    for df in ranked[1:]:
        whole = whole.unionByName(df)
    return whole


def merge_providers(*providers: DataFrame) -> DataFrame:
    """Routes of all providers, one per key, ordered by ``place``.

    A key keeps the place where it first appears and takes its values from its
    last row; later providers override earlier ones. The grouping carries two
    numbers per key, and geometry moves once, in the join back.
    """
    rows = _ranked(list(providers))
    spans = rows.groupBy("route_key").agg(F.min("place").alias("first_place"), F.max("place").alias("place"))
    return (
        rows.join(spans, ["route_key", "place"])
        .drop("place", "ordinal")
        .withColumnRenamed("first_place", "place")
    )


def single_provider(routes: DataFrame) -> DataFrame:
    """One provider's routes in cache order; repeated keys stay repeated."""
    return _ranked([routes]).drop("ordinal")


def route_lookup(routes: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """What a trip needs of a route, one row per key: its distance and its shard (last row wins)."""
    carried = routes.select("route_key", "place", "distance_meters")
    if shards is None:
        placed = carried.withColumn("shard_id", F.lit(None).cast("string"))
    else:
        placed = carried.join(shards.select("place", "shard_id"), "place", "left")
    last = placed.groupBy("route_key").agg(F.max_by(F.struct("distance_meters", "shard_id"), "place").alias("route"))
    return last.select("route_key", "route.*")


def route_join(trips: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add route_key, route_shard, route_distance_meters and route_reversed to located trips.

    The trip's key is null when an end is unmatched or both ends are one station;
    those trips, and trips whose pair is not cached, come out unrouted.
    """
    start, end = F.nullif("start_bikepoint_id", F.lit("")), F.nullif("end_bikepoint_id", F.lit(""))
    pair = F.concat(F.least(start, end), F.lit("|"), F.greatest(start, end))
    # Trips without a key match nothing; where routes are too many to broadcast they must not meet in one partition.
    plain = [F.col(f"`{f.name}`") for f in trips.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("string"))
    keyed = trips.withColumn("_pair", F.when(start.isNotNull() & end.isNotNull() & (start != end), pair).otherwise(spread))
    found = lookup.select(
        F.col("route_key").alias("_pair"),
        "route_key",
        F.col("shard_id").alias("route_shard"),
        F.col("distance_meters").alias("route_distance_meters"),
    )
    joined = keyed.join(found, "_pair", "left").drop("_pair")
    reverse = F.col("route_key").isNotNull() & (start > end)
    return joined.withColumn("route_reversed", F.coalesce(reverse, F.lit(False)))


def with_route_path(routed: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``route_path``, the route's coordinates oriented from trip start to trip end."""
    last = routes.groupBy("route_key").agg(F.max("place").alias("place"))
    paths = routes.join(last, ["route_key", "place"]).select("route_key", "coordinates")
    oriented = F.when(F.col("route_reversed"), F.reverse("coordinates")).otherwise(F.col("coordinates"))
    return routed.join(paths, "route_key", "left").withColumn("route_path", oriented).drop("coordinates")


def route_bytes(routes: DataFrame) -> DataFrame:
    """Add ``route_bytes``: length of the route as a compact one-entry JSON object."""
    entry = F.create_map("route_key", "coordinates")
    return routes.withColumn("route_bytes", F.length(F.to_json(entry)).cast("bigint"))


def pack_shards(
    routes: DataFrame,
    target_gzip_bytes: int = SHARD_GZIP_BYTES,
    compression_ratio: float = SHARD_COMPRESSION,
) -> DataFrame:
    """(place, route_key, route_bytes, shard_id): greedy packing in ``place`` order.

    A shard closes when it is not empty and the next route would push it past
    ``int(target * ratio)`` bytes, so each shard start depends on the one before.
    To keep that chain out of one task, the byte axis is cut into spans of many
    targets. Each span first works out where a shard entering it would leave it,
    for every row that can be entered (those within one target of its edge); the
    spans' short tables are then merged in levels, and each span labels its own rows.
    """
    if target_gzip_bytes <= 0:
        raise ValueError("shards need room: target_gzip_bytes is not positive")
    if compression_ratio <= 0:
        raise ValueError("compression_ratio is not positive")
    target = int(target_gzip_bytes * compression_ratio)
    span_bytes = max(target, 1) * _SPAN_TARGETS

    sized = route_bytes(routes).select("place", "route_key", "route_bytes")
    summed = with_running_totals(sized, [F.asc("place")], high=F.col("route_bytes"))
    rows = summed.select(
        "place",
        "route_key",
        "route_bytes",
        (F.col("high") - F.col("route_bytes")).alias("low"),
        "high",
    ).withColumn("span", F.floor(F.col("low") / span_bytes).cast("bigint"))

    crossings = rows.select("span", "low", "high").groupBy("span").applyInPandas(
        lambda span: _crossings(span, target, span_bytes),
        "span bigint, high bigint, exit_limit bigint, opened bigint",
    )
    entries = _entered(staged(crossings, "shard-crossings"), target, span_bytes)
    labelled = rows.join(entries, "span").groupBy("span").applyInPandas(
        lambda span: _label(span, target),
        "place bigint, route_key string, route_bytes bigint, shard bigint",
    )
    return labelled.select("place", "route_key", "route_bytes", F.format_string("shard-%04d", "shard").alias("shard_id"))


def _next_starts(low: np.ndarray, high: np.ndarray, target: int) -> np.ndarray:
    """For each row opening a shard, the index of the row that opens the next one."""
    past = np.searchsorted(high, low + target, side="right")
    return np.maximum(past, np.arange(len(low)) + 1)


def _crossings(span: pd.DataFrame, target: int, span_bytes: int) -> pd.DataFrame:
    """For rows a shard can open first in this span: the byte limit it leaves with, shards opened."""
    span = span.sort_values("high", ignore_index=True)
    low, high = span["low"].to_numpy(), span["high"].to_numpy()
    number = int(span["span"].iloc[0])
    following = _next_starts(low, high, target).tolist()
    limits, opened = (low + target).tolist(), [1] * len(low)
    for row in range(len(low) - 1, -1, -1):
        if following[row] < len(low):
            limits[row], opened[row] = limits[following[row]], opened[following[row]] + 1
    if number == 0:
        reach = 1
    else:
        reach = int(np.searchsorted(low, number * span_bytes + target, side="left"))
    return pd.DataFrame(
        {"span": number, "high": high[:reach], "exit_limit": limits[:reach], "opened": opened[:reach]}
    )


def _entered(crossings: DataFrame, target: int, span_bytes: int) -> DataFrame:
    """(span, limit, shard): the shard open at every span's edge, by merging neighbours in levels.

    The tables of neighbouring spans make one table, and those of its neighbours one again,
    until few are left. Their chain then tells what enters each of them, and so back down.
    No group holds more than ``_FAN`` short tables.
    """
    above = F.floor(F.col("span") / _FAN).cast("bigint").alias("above")
    schema = "span bigint, high bigint, exit_limit bigint, opened bigint"
    levels, wide = [crossings], span_bytes
    while (levels[-1].agg(F.max("span")).first()[0] or 0) >= _FAN:
        grouped = levels[-1].select("*", above).groupBy("above")
        levels.append(staged(grouped.applyInPandas(_merging(target, wide), schema), "shard-level"))
        wide *= _FAN
    entries = None
    for tables in reversed(levels):
        if entries is None:
            opened = tables.select("*", above, F.lit(-1).cast("bigint").alias("limit"), F.lit(-1).cast("bigint").alias("shard"))
        else:
            opened = tables.select("*", above).join(entries.withColumnRenamed("span", "above"), "above")
        entries = opened.groupBy("above").applyInPandas(_chain, "span bigint, limit bigint, shard bigint")
        entries = staged(entries, "shard-entries")
    return entries


def _merging(target: int, span_bytes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda tables: _merged(tables, target, span_bytes)


def _merged(tables: pd.DataFrame, target: int, span_bytes: int) -> pd.DataFrame:
    """One table for the spans of a group: what enters the first leaves the last as theirs in a row would have it."""
    number = int(tables["above"].iloc[0])
    high, limit, opened = (np.empty(0, np.int64) for _ in range(3))
    for span, table in sorted(tables.groupby("span"), reverse=True):
        table = table.sort_values("high")
        own = table["exit_limit"].to_numpy()
        entry = np.searchsorted(high, own, side="right")
        enters = entry < len(high)
        at = entry[enters]
        left, count = own.copy(), table["opened"].to_numpy().copy()
        left[enters] = limit[at]
        count[enters] += opened[at]
        # A shard that reaches over a whole span enters a later one.
        own_high, most = table["high"].to_numpy(), int(span) * span_bytes + target
        passing = 0 if len(own_high) and own_high[-1] > most else int(np.searchsorted(high, most, side="right")) + 1
        high = np.concatenate([own_high, high[:passing]])
        limit = np.concatenate([left, limit[:passing]])
        opened = np.concatenate([count, opened[:passing]])
    return pd.DataFrame({"span": number, "high": high, "exit_limit": limit, "opened": opened})


def _chain(tables: pd.DataFrame) -> pd.DataFrame:
    """Per span of a group: the byte limit of the shard open at its edge and that shard's number."""
    limit, shard, rows = int(tables["limit"].iloc[0]), int(tables["shard"].iloc[0]), []
    for number, span in tables.sort_values(["span", "high"]).groupby("span", sort=True):
        rows.append((number, limit, shard))
        entry = int(np.searchsorted(span["high"].to_numpy(), limit, side="right"))
        if entry < len(span):
            limit = int(span["exit_limit"].iloc[entry])
            shard += int(span["opened"].iloc[entry])
    return pd.DataFrame(rows, columns=["span", "limit", "shard"])


def _label(span: pd.DataFrame, target: int) -> pd.DataFrame:
    span = span.sort_values("high", ignore_index=True)
    low, high = span["low"].to_numpy(), span["high"].to_numpy()
    following = _next_starts(low, high, target)
    opens = np.zeros(len(low), dtype=np.int64)
    row = int(np.searchsorted(high, span["limit"].iloc[0], side="right"))
    while row < len(low):
        opens[row] = 1
        row = int(following[row])
    shard = int(span["shard"].iloc[0]) + opens.cumsum()
    return span[["place", "route_key", "route_bytes"]].assign(shard=shard)
