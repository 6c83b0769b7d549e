"""The landed station master: a JSON array of nested station objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.functions.text import name_key, numeric_key, text_or_null
from velospan.operators.running import numbered
from velospan.schemas import STATION_ID_PREFIX

# Property names of the published station objects.
BOOLEAN_PROPERTIES = {"installed": "Installed", "locked": "Locked", "temporary": "Temporary"}
DATE_PROPERTIES = {"install_date": "InstallDate", "removal_date": "RemovalDate"}
COUNT_PROPERTIES = {
    "nb_bikes": "NbBikes",
    "nb_empty_docks": "NbEmptyDocks",
    "nb_docks": "NbDocks",
    "nb_standard_bikes": "NbStandardBikes",
    "nb_ebikes": "NbEBikes",
}
TERMINAL_PROPERTY = "TerminalName"

STATION_OBJECT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("commonName", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField(
            "additionalProperties",
            T.ArrayType(
                T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
            ),
        ),
    ]
)


def read_station_master(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Station objects in file order, with ``ordinal``. A document that is not a list is an error."""
    documents = spark.read.text(paths, wholetext=True).select(
        F.col("value").alias("document"), F.col("_metadata.file_path").alias("file")
    )
    is_list = F.ltrim("document").startswith("[")
    checked = F.when(is_list, F.col("document")).otherwise(
        F.raise_error(F.lit("a station document is not a JSON array")).cast("string")
    )
    stations = documents.select(
        "file",
        F.posexplode(F.from_json(checked, T.ArrayType(STATION_OBJECT), {"mode": "FAILFAST"})).alias("at", "station"),
    )
    return numbered(stations, [F.asc("file"), F.asc("at")]).select("ordinal", "station.*")


def _property(name: str) -> Column:
    """The value of a property; the last one wins when it is repeated."""
    named = F.filter("additionalProperties", lambda item: item["key"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def flatten_stations(objects: DataFrame) -> DataFrame:
    """Station objects (with ``ordinal``) -> the 19-column station table and its match keys.

    Epoch dates are read in UTC. Text that is no number in a count or date
    property stops the job.
    """
    number = F.regexp_replace(F.coalesce("id", F.lit("")), f"^{STATION_ID_PREFIX}", "")
    terminal, name = text_or_null(_property(TERMINAL_PROPERTY)), text_or_null("commonName")

    def given(label: str) -> Column:
        return F.nullif(_property(label), F.lit(""))

    def utc(label: str) -> Column:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        seconds = given(label).cast("bigint") / 1000
        return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    return objects.select(
        "ordinal",
        F.coalesce("id", F.lit("")).alias("bikepoint_id"),
        number.alias("bikepoint_number"),
        numeric_key(number).alias("bikepoint_number_key"),
        terminal.alias("terminal_name"),
        numeric_key(terminal).alias("terminal_name_key"),
        name.alias("common_name"),
        name_key(name).alias("common_name_key"),
        "lat",
        "lon",
        *[(F.lower(given(label)) == "true").alias(column) for column, label in BOOLEAN_PROPERTIES.items()],
        *[utc(label).alias(column) for column, label in DATE_PROPERTIES.items()],
        *[given(label).cast("bigint").alias(column) for column, label in COUNT_PROPERTIES.items()],
    )
