"""Column expressions that several text operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the contracts, and the ASCII letters they lower-case.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(column: str = "text") -> Column:
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def require(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` itself, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in docs.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return docs


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` is called so (Spark ignores case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
