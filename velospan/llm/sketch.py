"""Fingerprints of documents as invertible Bloom lookup tables of their paragraphs.

A text's paragraphs are hashed to 64-bit digests; every digest goes to one cell in
each of three parts of a table, and a cell keeps how many digests it got, their
exclusive or, and that of their check values. Two tables of one size subtract cell by
cell: what both texts share vanishes. A cell left with a single digest gives it away;
taking it out of its other cells uncovers more (peeling). Where cells remain, the
tables were too small, and both are built again twice as large under other hashes.

Tables are rows (document, cell). Each document's digests are dealt to a partition
once, and building, subtracting and every round of peeling are aggregations inside it.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.llm.columns import BLANKS, require, whole_text
from velospan.operators.running import with_running_totals
from velospan.staging import staged

#: Parts of a table, and cells of each part in the table that is a document's fingerprint.
PARTS, PRINT_CELLS = 3, 4
#: Rounds of peeling before a pair's tables are enlarged, and enlargements.
ROUNDS, ATTEMPTS = 4, 12
#: Longest paragraph; longer ones are cut behind the last sentence or character that fits.
PARAGRAPH_CHARS = 160
_PARAGRAPH = rf"[^\n]{{1,{PARAGRAPH_CHARS - 1}}}[.!?](?=[\x20\x09-\x0D]|$)|[^\n]{{1,{PARAGRAPH_CHARS}}}"
#: Paragraphs' digests that a partition should hold.
PARTITION_DIGESTS = 250_000


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: its lines, long ones in pieces, without outer blanks."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(f"({_PARAGRAPH})"), F.lit(1)), lambda p: F.trim(p, F.lit(BLANKS)))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.hash(digest, F.lit(17))


def _cell(digest: Column, part: int, cells: Column, attempt: int) -> Column:
    return (F.pmod(F.xxhash64(digest, F.lit(101 * attempt + part)), cells) + part * cells).cast("int")


def _entries(digests: Column, sign: int, cells: Column, attempt: int) -> Column:
    """What an array of digests adds to the cells of a table."""

    def of(part: int) -> Column:
        return F.transform(
            digests,
            lambda d: F.struct(
                _cell(d, part, cells, attempt).alias("cell"), F.lit(sign).alias("n"), d.alias("x"), _check(d).alias("y")
            ),
        )

    return F.concat(*[of(part) for part in range(PARTS)])


def fingerprints(table: DataFrame, key: list[str], digests: str) -> DataFrame:
    """The smallest table of each row's digests as text: ``key`` and ``fingerprint``; equal sets, equal text."""
    rows = table.select(*key, F.explode(_entries(F.col(digests), 1, F.lit(PRINT_CELLS).cast("long"), 0)).alias("e"))
    cells = rows.groupBy(*key, F.col("e.cell").alias("cell")).agg(
        F.sum("e.n").alias("n"), F.bit_xor("e.x").alias("x"), F.bit_xor("e.y").alias("y")
    )
    shown = F.concat_ws(":", "cell", "n", F.hex("x"), F.hex("y"))
    return cells.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(shown)), " ").alias("fingerprint"))


def _peeled(cells: DataFrame, key: list[str], part: int, attempt: int) -> DataFrame:
    """One step: cells of one part that hold a single digest give it up, and its other cells lose it.

    A digest has one cell in a part, so no digest is taken out twice in a step. Cell -1
    counts what was recovered: digests of the first text only, and of the second only.
    """
    size, x, n = F.col("cells"), F.col("x"), F.col("n")
    single = (F.abs(n) == 1) & (F.col("y") == _check(x)) & (F.col("cell") == _cell(x, part, size, attempt))
    zero = F.lit(0).cast("long")

    def row(cell: Column, n: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
        return F.struct(cell.alias("cell"), n.alias("n"), x.alias("x"), y.alias("y"), a.alias("a"), b.alias("b"))

    others = [p for p in range(PARTS) if p != part]
    out = [row(_cell(x, p, size, attempt), -n, x, F.col("y"), zero, zero) for p in others]
    found = row(
        F.lit(-1), zero, zero, F.lit(0), F.when(n == 1, 1).otherwise(0).cast("long"), F.when(n == -1, 1).otherwise(0).cast("long")
    )
    kept = row(F.col("cell"), n, x, F.col("y"), F.col("a"), F.col("b"))
    spread = F.when((F.col("cell") >= 0) & single, F.array(*out, found)).otherwise(F.array(kept))
    return _summed(cells.select(*key, "cells", F.explode(spread).alias("e")).select(*key, "cells", "e.*"), key)


def _summed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Cells of one place added up; those that become empty are left out."""
    total = rows.groupBy(*key, "cells", "cell").agg(
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    return total.filter("cell < 0 OR n <> 0 OR x <> 0 OR y <> 0")


def _attempt(pairs: DataFrame, attempt: int, partitions: int) -> DataFrame:
    """``row``, ``which``, ``a``, ``b`` and ``left`` (cells that did not empty) for pairs of digest sets."""
    key = ["row", "which"]
    both = F.size("first") + F.size("second")
    cells = F.ceil(both * (0.47 * 2**attempt)) + 3
    dealt = pairs.repartition(partitions, "row").select(*key, cells.alias("cells"), "first", "second")
    mark = F.array(F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).alias("y")))
    minus = _entries(F.col("second"), -1, F.col("cells"), attempt)
    entries = F.concat(_entries(F.col("first"), 1, F.col("cells"), attempt), minus, mark)
    rows = dealt.select(*key, "cells", F.explode(entries).alias("e"))
    zero = F.lit(0).cast("long")
    now = _summed(rows.select(*key, "cells", "e.cell", F.col("e.n").cast("long").alias("n"), "e.x", "e.y", zero.alias("a"), zero.alias("b")), key)
    for _ in range(ROUNDS):
        for part in range(PARTS):
            now = _peeled(now, key, part, attempt)
    return now.groupBy(*key).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("left")
    )


def differences(pairs: DataFrame) -> DataFrame:
    """``row``, ``which``, ``a`` and ``b`` for pairs of digest sets ``first`` and ``second``.

    ``a`` digests are in the first set alone and ``b`` in the second alone, as peeling
    recovers them. Pairs whose tables stay undecided are tried again, twice as large.
    """
    require(pairs, "row", "which", "first", "second")
    done: DataFrame | None = None
    left = pairs
    for attempt in range(ATTEMPTS):
        load = left.agg(F.sum(F.size("first") + F.size("second"))).first()[0] or 0
        result = staged(_attempt(left, attempt, max(8, -(-int(load) // PARTITION_DIGESTS))), "sketch-attempt")
        decided = result.filter(F.col("left") == 0).select("row", "which", "a", "b")
        done = decided if done is None else done.union(decided)
        failed = result.filter(F.col("left") > 0).select("row", "which")
        if failed.isEmpty():
            return done
        left = staged(left.join(failed, ["row", "which"], "left_semi"), "sketch-undecided")
    raise RuntimeError(f"tables stay undecided after {ATTEMPTS} attempts")


def likeness(first: Column, a: Column, b: Column) -> Column:
    """Shared digests among all digests of both sets; 1 where both are empty."""
    every = F.size(first) + b
    return F.when(every == 0, F.lit(1.0)).otherwise((F.size(first) - a) / every)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Each distinct (id, text) by its keys, with its copies and the keys of the one before, ends joined."""
    distinct = docs.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("k2").asc()]
    placed = with_running_totals(distinct, order, rows=F.lit(1))
    placed = staged(placed.withColumnRenamed("rows_total", "total").drop("rows"), "sketch-order")
    before = placed.select(
        F.pmod(F.col("position") + 1, F.col("total")).alias("position"),
        F.col("k1").alias("before_k1"),
        F.col("k2").alias("before_k2"),
        F.floor(F.col("n") / 2).cast("int").alias("before_half"),
    )
    joined = placed.join(before, "position")
    return joined.select(
        F.col("k1").alias("of_k1"), F.col("k2").alias("of_k2"), "copies", "before_k1", "before_k2", "before_half"
    )


def edited_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its edited text: the last half gives way to as much of the next document's beginning.

    Documents are taken by ascending id, null ids last, equal ids by a hash of the text;
    copies that share both follow one another. After the last comes the first. Columns:
    ``doc_id``, ``next_id``, ``n_chars``, ``edited``, and the digests ``own``, ``next_digests``.
    """
    plain = require(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    # Two hashes that are never null stand for the pair of id and text: joins and windows on them share one exchange.
    plain = plain.withColumn("k1", F.xxhash64("doc_id")).withColumn("k2", F.xxhash64("text", F.col("doc_id").isNull()))
    near = staged(_neighbours(plain), "sketch-neighbours")
    # Texts are dealt out once; what the document before needs of one follows on its own.
    same = (plain["k1"] == near["of_k1"]) & (plain["k2"] == near["of_k2"])
    keyed = plain.join(near.hint("shuffle_merge"), same).withColumn("own", paragraph_digests(F.col("text")))
    keyed = keyed.withColumn("copy", F.row_number().over(W.partitionBy("k1", "k2").orderBy("before_k1")))
    lent = keyed.filter("copy = 1").select(
        F.col("before_k1").alias("for_k1"),
        F.col("before_k2").alias("for_k2"),
        F.col("doc_id").alias("lent_id"),
        F.left(F.col("text"), F.col("before_half")).alias("lent"),
        F.col("own").alias("next_own"),
    )
    takes = (keyed["k1"] == lent["for_k1"]) & (keyed["k2"] == lent["for_k2"])
    joined = keyed.join(lent.hint("shuffle_merge"), takes & (keyed["copy"] == keyed["copies"]), "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    last_copy = F.col("copy") == F.col("copies")
    begun = F.when(last_copy, F.col("lent")).otherwise(F.left(F.col("text"), half))
    return joined.select(
        "doc_id",
        F.when(last_copy, F.col("lent_id")).otherwise(F.col("doc_id")).alias("next_id"),
        n.cast("long").alias("n_chars"),
        F.concat(F.left(F.col("text"), n - half), begun).alias("edited"),
        "own",
        F.when(last_copy, F.col("next_own")).otherwise(F.col("own")).alias("next_digests"),
    )


def document_sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: both fingerprints and the likeness to the edited and to the next text.

    Null texts count as empty; empty texts have no paragraph, an empty fingerprint, and
    are like one another. Repeated rows have equal fingerprints. A table of one row is
    its own next document; an empty table gives an empty table.
    """
    edited = edited_versions(docs, doc_id, text)
    table = edited.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "next_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own",
        "next_digests",
        paragraph_digests(F.col("edited")).alias("edited_digests"),
    )
    table = staged(table, "sketch-digests")
    sides = F.array(
        F.struct(F.lit("edited").alias("which"), F.col("edited_digests").alias("second")),
        F.struct(F.lit("next").alias("which"), F.col("next_digests").alias("second")),
    )
    pairs = table.select("row", F.col("own").alias("first"), F.explode(sides).alias("side")).select("row", "first", "side.*")
    found = differences(pairs)
    near = found.groupBy("row").agg(*[
        F.max(F.when(F.col("which") == which, F.struct("a", "b"))).alias(which) for which in ("edited", "next")
    ])
    texts = F.array(
        F.struct(F.lit("own").alias("of"), F.col("own").alias("digests")),
        F.struct(F.lit("edited").alias("of"), F.col("edited_digests").alias("digests")),
    )
    each = table.repartition("row").select("row", F.explode(texts).alias("t")).select("row", "t.*")
    printed = fingerprints(each, ["row", "of"], "digests").groupBy("row").agg(*[
        F.max(F.when(F.col("of") == of, F.col("fingerprint"))).alias(f"{of}_print") for of in ("own", "edited")
    ])
    joined = table.join(near, "row").join(printed, "row", "left")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("own_print", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_print", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited.a"), F.col("edited.b")).alias("near_edited"),
        likeness(F.col("own"), F.col("next.a"), F.col("next.b")).alias("near_next"),
    )
