"""The file ledger: which landed files are new, changed, done, skipped or failed.

The ledger is a table. Every step joins it with what was found or done and
writes the result as a new version; the old version stays readable meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velospan.plans.versions import read_version, write_version
from velospan.schemas import LEDGER, LEDGER_COLUMNS, SCHEMA_VERSION, nullable

# Stage states and messages.
PENDING, DOWNLOADED, NORMALIZED, SKIPPED, VALIDATED, FAILED = (
    "pending",
    "downloaded",
    "normalized",
    "skipped",
    "validated",
    "failed",
)
ALL_DUPLICATES = "every member of the archive has landed as a file of its own"
NO_VALID_ROWS = "no row passed the rules"

_OBSERVED = ["etag", "size_bytes", "last_modified"]
_STATES = ["raw_status", "normalized_status", "validated_status"]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], nullable(LEDGER))


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def plan_raw(
    listing: DataFrame,
    ledger: DataFrame,
    order: list[str],
    limit: int | None = None,
    url_prefix: str = "",
    raw_prefix: str = "raw/",
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new ledger, files to fetch) from a listing.

    New files enter as pending. A changed etag, size or date resets everything
    known about a file. Files the listing does not name stay as they are. The
    limit cuts the plan, in ``order`` of the listing, and not the ledger.
    """
    seen = listing.select("source_key", *[F.col(c).alias(f"_seen_{c}") for c in _OBSERVED], *[
        F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)
    ], F.lit(True).alias("_listed"))
    both = ledger.withColumn("_known", F.lit(True)).join(seen, "source_key", "full_outer")
    listed = F.col("_listed").isNotNull()
    fresh = F.col("_known").isNull()
    same = [F.col(c).eqNullSafe(F.col(f"_seen_{c}")) for c in _OBSERVED]
    changed = listed & ~fresh & ~(same[0] & same[1] & same[2])
    reset = fresh | changed

    replaced = {
        "source_url": F.concat(F.lit(url_prefix), "source_key"),
        "raw_path": F.concat(F.lit(raw_prefix), "source_key"),
        **{c: F.col(f"_seen_{c}") for c in _OBSERVED},
        **{state: F.lit(PENDING) for state in _STATES},
        "discovered_at": F.when(fresh, _now() if now is None else now).otherwise(F.col("discovered_at")),
    }
    columns = ["source_key"]
    for field in LEDGER.fields[1:]:
        new = replaced.get(field.name, F.lit(None)).cast(field.dataType)
        columns.append(F.when(reset, new).otherwise(F.col(field.name)).alias(field.name))
    wanted = listed & (reset | (F.col("raw_status") != DOWNLOADED))
    marked = both.select(*columns, wanted.alias("_wanted"), *[f"_order_{i}" for i in range(len(order))])
    plan = marked.filter("_wanted")
    if limit is not None:
        plan = plan.orderBy(*[f"_order_{i}" for i in range(len(order))]).limit(limit)
    return marked.select(*LEDGER_COLUMNS), plan.select("source_key", *_OBSERVED, "source_url", "raw_path")


def _planned(ledger: DataFrame, before: Column, state: str, states: list[str], limit: int | None) -> DataFrame:
    files = ledger.filter(before & F.col(state).isin(states)).orderBy("source_key")
    return files if limit is None else files.limit(limit)


def plan_normalize(
    ledger: DataFrame, retry_failed: bool = False, force: bool = False, limit: int | None = None
) -> DataFrame:
    """Downloaded files still to normalize, by key."""
    states = [PENDING] + [FAILED] * retry_failed + [NORMALIZED, SKIPPED] * force
    return _planned(ledger, F.col("raw_status") == DOWNLOADED, "normalized_status", states, limit)


def downloaded_files(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("raw_status") == DOWNLOADED).orderBy("source_key")


def plan_validate(
    ledger: DataFrame, retry_failed: bool = False, force: bool = False, limit: int | None = None
) -> DataFrame:
    """Normalized files still to validate, by key."""
    states = [PENDING] + [FAILED] * retry_failed + [VALIDATED] * force
    return _planned(ledger, F.col("normalized_status") == NORMALIZED, "validated_status", states, limit)


def check_downloads(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Outcome of fetching planned files: ``landed`` gives (source_key, landed_bytes)."""
    sizes = plan.join(landed.select("source_key", "landed_bytes"), "source_key", "left")
    expected, got = F.col("size_bytes").cast("string"), F.col("landed_bytes").cast("string")
    key = F.col("source_key")
    problem = F.when(F.col("landed_bytes").isNull(), F.concat(F.lit("no landed file for "), key)).when(
        F.col("landed_bytes") != F.col("size_bytes"),
        F.concat(F.lit("wrong size of "), key, F.lit(": listed "), expected, F.lit(" bytes, landed "), got),
    )
    return sizes.select(
        "source_key", F.when(problem.isNull(), DOWNLOADED).otherwise(FAILED).alias("status"), problem.alias("error")
    )


def validation_outcome(counts: DataFrame) -> DataFrame:
    """Outcome rows from (source_key, valid_rows, invalid_rows): no valid row at all is a failure."""
    empty = F.col("valid_rows") == 0
    return counts.select(
        "source_key",
        F.when(empty, FAILED).otherwise(VALIDATED).alias("status"),
        F.when(empty, NO_VALID_ROWS).alias("error"),
        "valid_rows",
        "invalid_rows",
    )


def apply_outcomes(ledger: DataFrame, outcomes: DataFrame, stage: str, now: Column | None = None) -> DataFrame:
    """Stamp one stage's outcomes (source_key, status, error, ...) on the ledger.

    ``raw`` outcomes carry nothing more; ``normalize`` adds raw_rows, rows and
    path; ``validate`` adds valid_rows, invalid_rows, valid_path, invalid_path.
    A failed file keeps the counts and paths it had, except that a file that
    validated to nothing records its zero.
    """
    at = _now() if now is None else now
    status, error = F.col("_o.status"), F.col("_o.error")
    extra = set(outcomes.columns)

    def given(name: str) -> Column:
        return F.col(f"_o.{name}") if name in extra else F.lit(None)

    done = {"raw": status == DOWNLOADED, "normalize": status == NORMALIZED}.get(stage)
    updates: dict[str, Column] = {"error_message": error}
    if stage == "raw":
        updates["raw_status"] = status
        updates["raw_downloaded_at"] = F.when(done, at).otherwise(F.col("raw_downloaded_at"))
    elif stage == "normalize":
        skipped = status == SKIPPED

        def counted(name: str, kept: str) -> Column:
            return F.when(done, given(name)).when(skipped, F.lit(0)).otherwise(F.col(kept))

        updates["normalized_status"] = status
        path = F.when(done, given("path")).when(~skipped, F.col("normalized_path"))
        updates["normalized_path"] = path
        updates["row_count_raw"] = counted("raw_rows", "row_count_raw")
        updates["row_count_normalized"] = counted("rows", "row_count_normalized")
        updates["schema_version"] = F.when(done, F.lit(SCHEMA_VERSION)).otherwise(F.col("schema_version"))
        updates["processed_at"] = at
    elif stage == "validate":
        counted = given("valid_rows").isNotNull()
        updates["validated_status"] = status
        for column, name in (
            ("validated_path", "valid_path"),
            ("invalid_path", "invalid_path"),
            ("row_count_validated", "valid_rows"),
            ("row_count_invalid", "invalid_rows"),
        ):
            updates[column] = F.when(counted, given(name)).otherwise(F.col(column))
        updates["processed_at"] = at
    else:
        raise ValueError(f"unknown stage: {stage}")

    packed = outcomes.select("source_key", F.struct(*[c for c in outcomes.columns if c != "source_key"]).alias("_o"))
    touched = F.col("_o").isNotNull()
    return ledger.join(packed, "source_key", "left").select(
        "source_key",
        *[
            F.when(touched, updates[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in updates
            else F.col(f.name)
            for f in LEDGER.fields[1:]
        ],
    )


def write_ledger(ledger: DataFrame, root: str) -> str:
    """Write a new ledger version below ``root`` and make it current; returns its folder."""
    return write_version(ledger.select(*LEDGER_COLUMNS), root)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The current ledger version."""
    return read_version(spark, root, nullable(LEDGER))
