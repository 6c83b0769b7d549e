"""Mix sources to target weights by hash thresholds, without sorting documents.

A source's target is a number of whole passes over its documents and a fraction of
one more. The fraction takes documents whose hash is below a threshold. That
threshold is found level by level: sizes are summed by source and the next bits of
the hash, the bucket where the running sum passes the budget is the boundary, and
only documents inside the boundary bucket enter the next level. Histogram rows are
bounded per source; documents are never sorted or grouped by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.llm.columns import require, unused, whole_text, words
from velospan.staging import staged

WEIGHTS = (5, 2, 1)
CAP = 3
LEVELS, LEVEL_BITS = 4, 12
_HASH_BITS = LEVELS * LEVEL_BITS


def place_in_hash(doc_id: str) -> Column:
    """48 bits of the id's MD5; a null id counts as the text ``null``."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, _HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per ``source`` with ``source_size``.

    Weights repeat over sources in code point order, null last. All targets add up to
    all sizes; none exceeds ``cap`` times its source, and what one cannot take is
    shared by the others in proportion to their weights. Sources are ranked by the
    share at which they reach their cap: those before the first that stays below it
    are capped. Without any words all targets are 0.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    weighted = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    behind = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = weighted.withColumn("left", left).withColumn("behind", behind)
    # cap / weight against left / behind, in whole numbers
    level = level.withColumn("full", F.col("cap") * F.col("behind") < F.col("left") * F.col("weight"))
    open_now = F.when(~F.col("full"), F.struct("left", "behind"))
    first_open = F.first(open_now, ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    shared = level.withColumn("open", first_open)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("open.left")).cast("double") / F.col("open.behind")
    )
    return shared.select("source", "source_size", "weight", target.alias("target"))


def thresholds(digest: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source: ``cut`` (hashes below are in), ``at`` (the boundary hash), and its ``rest`` and ``at_size``.

    ``digest`` has ``source``, ``size`` and ``h``; ``budgets`` has ``source`` and
    ``budget``. Documents that share the boundary hash share what is left of the budget.
    """
    bits, level_rows = _HASH_BITS, digest
    found = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for _ in range(LEVELS):
        bits -= LEVEL_BITS
        bucket = F.shiftright("h", bits)
        histogram = level_rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        summed = histogram.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
        wanted = found.withColumnRenamed("source", "_source")
        at = summed.join(wanted, summed["source"].eqNullSafe(wanted["_source"]))
        inside = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size"))
        boundary = at.filter(inside).select(
            "source",
            F.col("bucket").alias("prefix"),
            (F.col("rest") - F.col("before")).alias("rest"),
            F.col("bucket_size").alias("at_size"),
        )
        found = staged(boundary, "mix-boundary")
        edge = found.select(F.col("source").alias("_source"), F.col("prefix").alias("_prefix"))
        match = level_rows["source"].eqNullSafe(edge["_source"]) & (bucket == edge["_prefix"])
        if bits:
            level_rows = staged(level_rows.join(edge, match, "left_semi"), "mix-boundary-rows")
    return found.select("source", F.col("prefix").alias("at"), "rest", "at_size")


def _digest(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.size(words(whole_text(text))).cast("long").alias("size"),
        place_in_hash(doc_id).alias("h"),
    )


def mix_plan(digest: DataFrame) -> DataFrame:
    """One row per source: ``_source``, its size and target, whole ``passes``, and the threshold of the rest."""
    sizes = digest.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = targets.withColumn("passes", passes)
    budget = F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")
    planned = planned.withColumn("budget", budget)
    edge = thresholds(digest, planned.select("source", "budget")).withColumnRenamed("source", "_of")
    plan = planned.join(edge, planned["source"].eqNullSafe(edge["_of"]), "left")
    return plan.select(F.col("source").alias("_source"), "source_size", "target", "passes", "budget", "at", "rest", "at_size")


def _share() -> Column:
    """Words of a document in the pass that takes a fraction of its source."""
    below = F.when(F.col("at").isNull(), F.when(F.col("budget") > 0, F.col("size")).otherwise(0))
    at = F.when(F.col("h") == F.col("at"), F.expr("(size * rest) div at_size"))
    return F.coalesce(below.when(F.col("h") < F.col("at"), F.col("size")), at, F.lit(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: the id, ``source``, ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` is whole passes plus the fraction's share: documents below the source's
    threshold are taken once more in full, those at the threshold in part, so that a
    source comes within a word of its target (rows that repeat the id at the threshold
    share it, less a word each at most). Null texts have size 0 and nothing is taken
    of them. A null source is a source. An empty table gives an empty table.
    """
    require(docs, doc_id, text, source)
    digest = staged(_digest(docs, doc_id, text, source), "mix-sizes")
    plan = mix_plan(digest)
    joined = digest.join(plan, digest["source"].eqNullSafe(plan["_source"]))
    taken = F.col("passes") * F.col("size") + _share()
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes words of a document.

    Whole passes repeat the row as it is; the part of a document at its source's
    threshold is its first words, up to the end of the last one. A document of which
    the mix takes nothing has no row. Rows that share an id are taken alike.
    """
    require(docs, doc_id, text, source)
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    inputs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    plan = mix_plan(staged(_digest(docs, doc_id, text, source), "mix-sizes"))
    sized = inputs.withColumns({"size": F.size(words(whole_text(names[text]))).cast("long"), "h": place_in_hash(names[doc_id])})
    joined = sized.join(plan, sized[names[source]].cast("string").eqNullSafe(plan["_source"]))
    copies = F.concat(F.array_repeat(F.col("size"), F.col("passes").cast("int")), F.array(_share()))
    each = joined.withColumn("take", F.explode(F.filter(copies, lambda n: n > 0)))
    pieces = F.regexp_extract_all(names[text], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(pieces, 1, F.col("take").cast("int")), "")
    text_now = F.when(F.col("take") < F.col("size"), cut).otherwise(F.col(names[text]))
    return each.withColumn(names[text], text_now).select(*[F.col(n).alias(c) for c, n in names.items()])
