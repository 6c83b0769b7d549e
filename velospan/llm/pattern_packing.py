"""Pack pieces of texts into sequences by length patterns fitted with least squares.

The corpus enters the plan only as a histogram of piece lengths, at most one number
per length, so the plan costs the same at every size. Patterns of a few lengths that
fill a sequence are enumerated on a coarse grid, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left over is
packed into the space that is still free. The plan is a list of runs: so many
pieces of one length, by their rank within it, go to consecutive sequences at one
offset. Ranks within a length are counted per hash bucket, so a length that a third
of all pieces share is never sorted in one task.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.llm.columns import require
from velospan.llm.memory import give_back
from velospan.llm.token_ids import WORD_BPE, tokenizer_path, word_encoder
from velospan.staging import staged

CAPACITY = 2048
#: Cells of the grids on which patterns are enumerated, and most pieces in a pattern.
GRIDS = ((64, 4), (128, 3))
#: Parts of the fitted repeats that a plan follows; the rest stays free to fill space.
SHARES = (1.0, 0.9, 0.6, 0.3)
#: A pattern's last piece is placed with it only if it leaves at most this much space.
TIGHT = 4
#: Pieces that one rank bucket should hold.
BUCKET_PIECES = 5_000
#: The id that ends every document.
END_ID = 0
RUN_SCHEMA = "length int, rank_from long, n long, sequence_from long, offset int"


# -- the plan, from a histogram --------------------------------------------------


def patterns(grid: int, parts: int) -> np.ndarray:
    """Multisets of at most ``parts`` cells that add up to ``grid``, as rows, largest first, padded with 0."""
    rows: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            rows.append(head + (0,) * (parts - len(head)))
        elif len(head) < parts:
            most = min(left, head[-1] if head else grid)
            least = -(-left // (parts - len(head)))
            for cell in range(most, least - 1, -1):
                extend((*head, cell), left - cell)

    extend((), grid)
    return np.array(rows, np.int64)


def fit_counts(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least squares of ``a @ x`` against ``b`` with all x >= 0, by the active-set method.

    The most promising column enters; columns that would turn negative leave.
    """
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gradient = a.T @ b
    for _ in range(rounds or 4 * a.shape[0]):
        best = int(np.argmax(np.where(free, -np.inf, gradient)))
        if gradient[best] <= 1e-7 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[best] = True
        while True:
            columns = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[columns] = solved
                break
            falling = solved <= 0
            now = x[columns]
            step = np.min(now[falling] / np.maximum(now[falling] - solved[falling], 1e-300))
            x[columns] = np.maximum(now + step * (solved - now), 0)
            free[columns[falling & (x[columns] <= 1e-9)]] = False
            x[~free] = 0
            if not free.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


class _Plan:
    """Runs made so far, pieces left per length, and sequences with space by free space."""

    def __init__(self, histogram: np.ndarray, capacity: int) -> None:
        self.left = histogram.astype(np.int64)
        self.used = np.zeros_like(self.left)
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []  # free spaces that occur, ascending

    def leave(self, free: int, first: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in self.open:
                self.open[free] = []
                bisect.insort(self.spaces, free)
            self.open[free].append((first, n))

    def start(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, first: int, free: int) -> None:
        self.runs.append((length, int(self.used[length]), n, first, self.capacity - free))
        self.used[length] += n
        self.left[length] -= n

    def longest(self, most: int, above: int) -> int:
        """The longest piece left that is at most ``most`` and more than ``above``; 0 if there is none."""
        found = np.flatnonzero(self.left[above + 1 : most + 1])
        return above + 1 + int(found[-1]) if len(found) else 0

    def follow(self, pattern: list[int], n: int, width: int) -> None:
        """Open ``n`` sequences with a pattern's pieces; the last piece is the longest one that fits."""
        heads = int(self.left[(pattern[0] - 1) * width + 1 : pattern[0] * width + 1].sum())
        n = min(n, heads)
        groups = [(self.start(n), n, self.capacity)] if n else []
        for place, cell in enumerate(pattern):
            final, after = place == len(pattern) - 1, []
            while groups:
                first, count, free = groups.pop()
                most = free if final else min(free, cell * width)
                length = self.longest(most, max(0, free - TIGHT - 1) if final else min(most, (cell - 1) * width))
                if not length:
                    after.append((first, count, free))
                    continue
                taken = min(count, int(self.left[length]))
                self.put(length, taken, first, free)
                after.append((first, taken, free - length))
                if taken < count:
                    groups.append((first + taken, count - taken, free))
            groups = after
        for first, count, free in groups:
            self.leave(free, first, count)

    def best_fit(self, length: int) -> None:
        """Pack all pieces left of one length: least sufficient space first, then new sequences.

        A space is filled with as many of the pieces as it holds before the next is begun,
        since what one piece leaves of it is then the least sufficient space.
        """
        while self.left[length]:
            at = bisect.bisect_left(self.spaces, length)
            free = self.spaces[at] if at < len(self.spaces) else self.capacity
            times = free // length
            wanted = -(-int(self.left[length]) // times)
            if at == len(self.spaces):
                first, have = self.start(wanted), wanted
            else:
                first, have = self.open[free].pop()
                if have > wanted:
                    self.open[free].append((first + wanted, have - wanted))
                    have = wanted
                elif not self.open[free]:
                    del self.open[free], self.spaces[at]
            full = min(have, int(self.left[length]) // times)
            if full:
                for i in range(times):
                    self.put(length, full, first, free - i * length)
                self.leave(free - times * length, first, full)
            if full < have:  # one sequence more takes the last few
                few = int(self.left[length])
                for i in range(few):
                    self.put(length, 1, first + full, free - i * length)
                self.leave(free - few * length, first + full, 1)


def _fitted(left: np.ndarray, capacity: int, grid: int, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Patterns, their fitted repeats, and the width of a cell; a piece counts at its cell's upper end."""
    width = -(-capacity // grid)
    cells = capacity // width
    counts = np.zeros(cells + 1)
    lengths = np.arange(1, capacity)
    np.add.at(counts, np.minimum(-(-lengths // width), cells), left[1:capacity])
    shapes = patterns(cells, parts)
    shapes = shapes[((counts[shapes] > 0) | (shapes == 0)).all(axis=1)]
    if not len(shapes):
        return shapes, np.zeros(0), width
    columns = np.zeros((cells + 1, len(shapes)))
    for part in range(parts):
        np.add.at(columns, (shapes[:, part], np.arange(len(shapes))), 1)
    return shapes, fit_counts(columns[1:], counts[1:]), width


def plan_runs(histogram: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs (columns of ``RUN_SCHEMA``) that place every piece; ``histogram[n]`` counts pieces of n tokens.

    Full pieces are sequences of their own. Repeats are rounded down, and what is left
    over goes, longest first, to the least space that holds it. How much of a fit is
    followed, and on which grid, is tried out: the plan with the fewest sequences wins.
    """
    histogram = np.asarray(histogram, np.int64)[: capacity + 1]
    best = None
    for grid, parts in GRIDS:
        shapes, fitted, width = _fitted(histogram, capacity, min(grid, capacity), parts)
        for share in SHARES:
            plan = _Plan(histogram, capacity)
            if plan.left[capacity]:
                full = int(plan.left[capacity])
                plan.put(capacity, full, plan.start(full), capacity)
            repeats = np.floor(share * fitted + 1e-6).astype(np.int64)
            # Patterns with the longest pieces first; among them the commonest.
            for i in sorted(np.flatnonzero(repeats), key=lambda i: (-shapes[i, 0], -repeats[i])):
                plan.follow([int(c) for c in shapes[i] if c], int(repeats[i]), width)
            for length in range(capacity, 0, -1):
                plan.best_fit(length)
            if best is None or plan.sequences < best.sequences:
                best = plan
    return pd.DataFrame(best.runs, columns=["length", "rank_from", "n", "sequence_from", "offset"])


# -- the corpus ------------------------------------------------------------------


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = WORD_BPE,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    A document is the ids of its whole text and the end id; a null text is empty and
    so one piece of one id. Documents longer than ``capacity`` are cut after every
    ``capacity`` ids, others never. Repeated rows give repeated pieces.
    """
    require(docs, doc_id, text)
    kind = "struct<n: bigint, crcs: array<bigint>" + (", ids: array<array<bigint>>>" if keep_ids else ">")

    @F.arrow_udf(kind)
    def encoded(texts: pa.Array) -> pa.Array:
        rows = []
        for ids, offsets in word_encoder(tokenizer_path(tokenizer)).slices(texts):
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                whole = np.append(ids[low:high], np.uint32(END_ID)).astype("<u4")
                cuts = [whole[at : at + capacity] for at in range(0, len(whole), capacity)]
                row = {"n": len(whole), "crcs": [zlib.crc32(cut.tobytes()) for cut in cuts]}
                rows.append(row | ({"ids": [cut.tolist() for cut in cuts]} if keep_ids else {}))
        kept = [("ids", pa.list_(pa.list_(pa.int64())))] if keep_ids else []
        made = pa.array(rows, pa.struct([("n", pa.int64()), ("crcs", pa.list_(pa.int64())), *kept]))
        del rows
        give_back()
        return made

    done = docs.select(F.col(doc_id).alias("doc_id"), encoded(F.col(text).cast("string")).alias("e"))
    cut = done.select("doc_id", "e", F.posexplode("e.crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("e.n") - start)
    ids = [F.get(F.col("e.ids"), F.col("piece")).alias("ids")] if keep_ids else []
    return cut.select("doc_id", "piece", start.alias("start"), length.alias("length"), "ids_crc32", *ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32``.

    ``pieces`` must give the same rows whenever it is read, as a written table does;
    pieces that are equal in all five may swap places. No piece, no sequence.
    """
    require(pieces, "doc_id", "piece", "start", "length", "ids_crc32")
    counted = pieces.groupBy("length").count().collect()  # at most one row per length up to the capacity
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        if not 1 <= row["length"] <= capacity:
            raise ValueError(f"a piece of {row['length']} tokens")
        histogram[row["length"]] = row["count"]
    buckets = [int(max(1, -(-n // BUCKET_PIECES))) for n in histogram[1:]]
    hashed = F.xxhash64("doc_id", "piece", "ids_crc32")
    bucket = F.pmod(hashed, F.element_at(F.lit(buckets), F.col("length").cast("int")))
    dealt = pieces.withColumn("_bucket", bucket)
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_bucket").count()
    offsets = offsets.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(inside)).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    # A few runs per length: their number follows the capacity, not the corpus.
    runs = pieces.sparkSession.createDataFrame(plan_runs(histogram, capacity), RUN_SCHEMA)
    runs = F.broadcast(runs.withColumnRenamed("length", "_length"))
    within = (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_from") + F.col("n"))
    placed = ranked.join(runs, (F.col("length") == F.col("_length")) & within)
    sequence = F.col("sequence_from") + F.col("_rank") - F.col("rank_from")
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(staged(token_pieces(docs, doc_id, text, capacity), "token-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces that kept their ``ids``: at most ``capacity`` ids a row."""
    require(packed, "sequence_id", "offset", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
