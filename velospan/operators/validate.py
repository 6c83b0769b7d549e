"""Rule-based row validation: valid rows, rejected rows, counts per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.functions.clock import millis_between
from velospan.schemas import TRIP
from velospan.staging import staged

# Limits of the trip contract.
MIN_TEXT_LENGTH = 1
MIN_VALUE = {"duration_seconds": 0, "duration_ms": 0, "source_row_number": 1}
CLOCK_TOLERANCE_MS = 120_000
LONGEST_TRIP_MS = 14 * 24 * 60 * 60 * 1000

_KEY = ["source_key", "journey_id"]
_RULES = "rules"


def _row_rules(cast_columns: list[str]) -> dict[str, Column]:
    """Rule name -> predicate over one trip; a null predicate counts as a pass."""
    rules: dict[str, Column] = {}
    for field in TRIP:
        column = F.col(field.name)
        if field.name in cast_columns:
            rules[f"{field.name}|dtype"] = ~F.col(f"_lost_{field.name}")
        if not field.nullable:
            rules[f"{field.name}|nullability"] = column.isNotNull()
        if isinstance(field.dataType, T.StringType):
            rules[f"{field.name}|min_length"] = F.length(column) >= MIN_TEXT_LENGTH
        if field.name in MIN_VALUE:
            rules[f"{field.name}|min"] = column >= MIN_VALUE[field.name]
    seconds, millis = F.col("duration_seconds"), F.col("duration_ms")
    floor_ms = F.try_multiply(seconds, F.lit(1000).cast("bigint"))
    measured = millis_between(F.col("start_at"), F.col("end_at"))
    rules["end_not_before_start"] = F.col("end_at") >= F.col("start_at")
    rules["duration_units_agree"] = (millis >= floor_ms) & (F.try_subtract(millis, floor_ms) < 1000)
    rules["duration_matches_timestamps"] = F.try_subtract(millis, measured).between(
        -CLOCK_TOLERANCE_MS, CLOCK_TOLERANCE_MS
    )
    rules["plausible_duration"] = millis <= LONGEST_TRIP_MS
    return rules


def _conform(trips: DataFrame) -> tuple[DataFrame, list[str]]:
    """Cast to the trip schema; columns whose type changed remember values lost on the way."""
    present = {field.name: field.dataType for field in trips.schema}
    changed = [f.name for f in TRIP if f.name in present and present[f.name] != f.dataType]
    columns = []
    for field in TRIP:
        source = F.col(field.name) if field.name in present else F.lit(None)
        kept = source.try_cast(field.dataType) if field.name in changed else source.cast(field.dataType)
        columns.append(kept.alias(field.name))
        if field.name in changed:
            columns.append((source.isNotNull() & kept.isNull()).alias(f"_lost_{field.name}"))
    return trips.select(*columns), changed


def repeated_keys(trips: DataFrame) -> DataFrame:
    """(source_key, journey_id) pairs that occur more than once in a source.

    Only the two key columns are read and counted, with partial sums before the
    shuffle, so a key that holds a large share of the rows stays one row per task.
    """
    return trips.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(*_KEY)


def check_trips(trips: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Every trip with ``failed_rules``, the names of the rules it breaks (empty: valid).

    Columns of another type than the trip's are cast first, and a value that is lost by
    it breaks the rule ``column|dtype``. The repeated keys are staged first: they are few in healthy data, and as a
    table of known size they reach the rows by a broadcast when that is safe and
    by a shuffle join (whose hot partitions AQE splits) when it is not. Either
    way the full rows are never grouped by key.
    """
    conformed, changed = _conform(trips)
    if keys is None:
        keys = staged(repeated_keys(conformed), "repeated-keys")
    repeats = keys.select(*[F.col(name).alias(f"_repeat_{name}") for name in _KEY], F.lit(True).alias("_repeated"))
    same = [F.col(name).eqNullSafe(F.col(f"_repeat_{name}")) for name in _KEY]
    rules = {"primary_key": F.col("_repeated").isNull()} | _row_rules(changed)
    broken = [F.when(~passes, F.lit(name)) for name, passes in rules.items()]
    # The column carries the rules that were checked, those of changed columns among them.
    failed = F.array_compact(F.array(*broken)).alias("failed_rules", metadata={_RULES: list(rules)})
    return conformed.join(repeats, same, "left").select(*TRIP.fieldNames(), failed)


def rule_names(changed: list[str] | None = None) -> list[str]:
    return ["primary_key", *_row_rules(changed or [])]


def valid_trips(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("failed_rules") == 0).drop("failed_rules")


def checked_rules(checked: DataFrame) -> list[str]:
    """The rules that ``check_trips`` looked at, also where its result was written and read again."""
    return checked.schema["failed_rules"].metadata.get(_RULES) or rule_names()


def rejected_trips(checked: DataFrame) -> DataFrame:
    """Rejected rows with a ``valid`` / ``invalid`` column per rule, casts of changed columns included."""
    rejects = checked.filter(F.size("failed_rules") > 0)
    statuses = [
        F.when(F.array_contains("failed_rules", name), "invalid").otherwise("valid").alias(name)
        for name in checked_rules(checked)
    ]
    return rejects.select("*", *statuses)


def split_valid(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of trips that are checked once."""
    checked = staged(check_trips(trips), "checked-trips")
    return valid_trips(checked), rejected_trips(checked)


def rule_counts(checked: DataFrame) -> DataFrame:
    """Rejected rows per broken rule."""
    return (
        checked.select("source_key", F.explode("failed_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rejected"))
    )
