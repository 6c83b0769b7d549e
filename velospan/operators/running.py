"""Running totals over a whole ordered table, without an un-partitioned window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.staging import staged


def with_running_totals(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Add ``position`` (from 0 in ``order``) and, per keyword, its running sum and ``<name>_total``.

    ``order`` must be a total order. Rows are range-partitioned into blocks on it
    and staged once, so that block membership is settled; each block is then
    summed on its own and shifted by the totals of the blocks before it. Only the
    block totals, one row per block, ever meet in one place.
    """
    split = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_block"))
    blocks = staged(split, "running")
    sums = {"position": F.lit(1), **values}

    inside = W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = blocks.select("*", *[F.sum(value).over(inside).alias(f"_in_{name}") for name, value in sums.items()])

    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = blocks.groupBy("_block").agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    everything = W.orderBy("_block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = totals.select(
        "_block",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(name).over(everything).alias(f"{name}_total") for name in values],
    )
    # One row per block: its size is the number of shuffle partitions, not of data.
    shifted = local.join(F.broadcast(before), "_block")
    done = {name: F.col(f"_in_{name}") + F.col(f"_before_{name}") for name in sums}
    done["position"] = done["position"] - 1
    return shifted.select(
        *df.columns, *[total.alias(name) for name, total in done.items()], *[f"{name}_total" for name in values]
    )


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Add a dense number from 0 in ``order``."""
    return with_running_totals(df, order).withColumnRenamed("position", name)
