"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A text's words are sorted by what follows them (suffix array, its inverse, and common
prefixes of neighbours). Every interval of a common prefix splits in two at each of its
least values; a square whose two halves part after it has one half on either side, so
only the suffixes of the smaller side are looked at, and the inverse array tells whether
the place a prefix length before or after them is on the other side. Such squares are
rotated to the left as far as they go, and those that cover the same stretch are one run
of the smallest period. No tree is built; work is n log n for n words. Many texts are
sorted together: the words of each are numbers of its own, so nothing crosses texts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has this many words and this many periods at least, unless others are given.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words that are sorted together (a longer text is sorted alone), and suffixes tested at a time.
SLICE_WORDS, TESTED_AT_ONCE = 400_000, 2_000_000

_RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
_FOUND = T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(_RUN)).add("collapsed", T.StringType())
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where the group of equal neighbours begins that each entry belongs to."""
    begins = np.r_[True, keys[1:] != keys[:-1]]
    return np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))


def suffix_array(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of all texts in order, and the ranks by their first 1, 2, 4, ... words.

    Suffixes end with their text and never share a rank with those of another. Only
    suffixes that are not yet alone in their rank are sorted again.
    """
    n = len(words)
    keys = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(keys, kind="stable")
    first = _groups(keys[order])
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = first, -1
    levels, reach = [rank.copy()], 1
    beyond = np.append(text, -1)
    active = np.arange(n)
    while True:
        sizes = np.bincount(first, minlength=0)
        active = active[sizes[first] > 1]
        if not len(active):
            return order, levels
        some = order[active]
        ahead = np.minimum(some + reach, n)
        second = np.where(beyond[ahead] == text[some], rank[ahead], -1)
        keys = rank[some].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(keys, kind="stable")
        order[active] = some = some[by]
        group = _groups(keys[by])
        rank[some] = active[group]
        first = group
        levels.append(rank.copy())
        reach *= 2


def _common_prefix(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes a and b share, by ranks of halving lengths."""
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += (levels[k][a + shared] == levels[k][b + shared]).astype(np.int64) << k
    return shared


def _splits(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each boundary with a common prefix, and the ends of the interval that it splits.

    Boundary j lies between sorted suffixes j - 1 and j. Its interval begins at the last
    boundary before that is no larger and ends at the first behind that is smaller.
    """
    at = np.flatnonzero(prefix)
    places, values = at.tolist(), prefix[at].tolist()
    low, high = [0] * len(places), [0] * len(places)
    open_: list[int] = []
    begin, last = -1, -2
    for i, j in enumerate(places):
        if j != last + 1:
            for x in open_:
                high[x] = last + 1
            open_.clear()
            begin = j - 1
        value = values[i]
        while open_ and values[open_[-1]] > value:
            high[open_.pop()] = j
        low[i] = places[open_[-1]] if open_ else begin
        open_.append(i)
        last = j
    for x in open_:
        high[x] = last + 1
    return at, np.array(low, np.int64), np.array(high, np.int64)


def _squares(order: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose halves are followed by different words."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    at, low, high = _splits(prefix)
    left_smaller = at - low <= high - at
    first = np.where(left_smaller, low, at)
    counts = np.where(left_smaller, at - low, high - at)
    # The other side of each split, where a partner must lie.
    from_, upto = np.where(left_smaller, at, low), np.where(left_smaller, high, at)
    starts, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.cumsum(counts)
    cut = 0
    while cut < len(at):
        before = ends[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(ends, before + TESTED_AT_ONCE, side="right")))
        c = counts[cut:stop]
        node = np.repeat(np.arange(cut, stop), c)
        suffix = order[np.arange(len(node)) + np.repeat(first[cut:stop] - (np.cumsum(c) - c), c)]
        depth = prefix[at[node]]
        for partner, start in ((suffix + depth, suffix), (suffix - depth, suffix - depth)):
            inside = (partner >= 0) & (partner < n)
            place = inverse[np.where(inside, partner, 0)]
            hit = inside & (place >= from_[node]) & (place < upto[node])
            starts.append(start[hit])
            periods.append(depth[hit])
        cut = stop
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(
    words: np.ndarray, offsets: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``words`` are numbers, those of text t at ``offsets[t]:offsets[t + 1]``. A run is a
    stretch with smallest period p that no neighbour extends, of ``least_length`` words
    and ``least_exponent`` (2 or more) periods at least.
    """
    n = len(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not n:
        return np.empty((0, 4), np.int64)
    order, levels = suffix_array(words, text)
    prefix = np.zeros(n, np.int64)
    prefix[1:] = _common_prefix(order[:-1], order[1:], levels)
    start, period = _squares(order, prefix)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):
        back = start - (1 << k)
        inside = np.maximum(back, 0)
        same = (back >= 0) & (levels[k][inside] == levels[k][inside + period])
        start = np.where(same, back, start)
    by = np.lexsort((period, start, end))
    start, end, period = start[by], end[by], period[by]
    length = end - start
    # Squares of several periods cover the same stretch as those of the smallest.
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    long = smallest & (length >= least_length) & (length >= least_exponent * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    own = text[start]
    return np.stack([own, start - np.asarray(offsets)[own], length, period], axis=1)


def _batch(lists: pa.Array, least_length: int, least_exponent: int) -> pa.Array:
    """Words, runs and collapsed text of each list of words; a null list is empty."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found, at = [np.empty((0, 4), np.int64)], 0
    while at < len(lists):
        upto = int(np.searchsorted(offsets, offsets[at] + SLICE_WORDS, side="right")) - 1
        upto = min(max(upto, at + 1), len(lists))
        runs = find_runs(codes[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at], least_length, least_exponent)
        runs[:, 0] += at
        found.append(runs)
        at = upto
    text, start, length, period = np.concatenate(found).T
    # +1 where the part behind a run's first period begins, -1 where the run ends.
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, offsets[text] + start + period, 1)
    np.add.at(steps, offsets[text] + start + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.filter(pa.array(kept)).cast(pa.string()))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(lists)))])
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_ARROW_RUN))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(offsets), pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows),
            pc.binary_join(left, " "),
        ],
        names=["n_words", "runs", "collapsed"],
    )


def with_runs(
    docs: DataFrame,
    words: Column,
    name: str = "periodic",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """``docs`` with a column ``name`` (replaced if there): ``n_words``, ``runs`` and ``collapsed``.

    ``words`` is an array of strings per row. ``runs`` holds (start, length, period) by
    start and period, places from 0; ``collapsed`` joins by blanks the words that no run
    contains behind its first period. A null or empty array has no words, no runs and an
    empty text; repeated rows get equal results, an empty table gives an empty one.
    Rows stay where they are: nothing is shuffled.
    """
    if least_exponent < 2 or least_length < 1:
        raise ValueError("a run has two periods and one word at least")
    find = partial(_batch, least_length=least_length, least_exponent=least_exponent)

    @F.arrow_udf(_FOUND)
    def found(lists: pa.Array) -> pa.Array:
        return find(lists)

    return docs.withColumn(name, found(words))


# -- what the registered query asks for --------------------------------------------


def repeated_words(words: Column, doc_id: Column) -> Column:
    """Words of a text, of which one in ten texts repeats a part up to its end.

    With h the crc32 of the id as text (a null id counts as empty text) and g = h // 10:
    where h ends in 0, word i from a = g % n on becomes word a + (i - a) % p, with
    p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    put = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))
    return F.when((h % 10 == 0) & (n > 0), put).otherwise(words)


def run_columns(found: str) -> dict[str, Column]:
    """Number of runs, the one of the greatest exponent, and digests, of a column made by ``with_runs``."""
    runs = F.col(f"{found}.runs")
    none = F.lit(None).cast(_RUN)
    # Runs come by start and period, so a tie leaves the one before.
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    best = F.aggregate(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))
    line = lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))
    return {
        "n_runs": F.size(runs).cast("long"),
        "best": best,
        "runs_sha256": F.sha2(F.array_join(F.transform(runs, line), ""), 256),
        "collapsed_sha256": F.sha2(F.col(f"{found}.collapsed"), 256),
    }
