"""Suffix arrays by induced sorting, and common prefixes in text order.

Suffixes are classified as larger or smaller than the one that follows them. The
leftmost of each run of smaller ones are sorted: their substrings by one induction, and,
where substrings repeat, by the suffix array of their names. All other suffixes follow
from them in two linear passes. Over small alphabets a pass moves whole buckets at a time,
over the names of a recursion it moves suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are passed bucket by bucket.
BUCKETS = 1024


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that follows; the last one, a least symbol, counts as such."""
    begins = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    symbols = s[begins]
    rising = np.r_[symbols[1:] > symbols[:-1], True]
    return np.repeat(rising, np.diff(np.r_[begins, len(s)]))


def _dealt(places: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append places to the lists of their symbols, in order."""
    by = np.argsort(symbols, kind="stable")
    ordered, places = symbols[by], places[by]
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(places)], strict=True):
        into[ordered[low]].append(places[low:high])


def _by_bucket(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, induced from ``seeds`` (leftmost smaller ones in the order of their buckets)."""
    none = np.empty(0, np.int64)
    own = s[seeds]
    seeds_of = np.searchsorted(own, np.arange(size + 1)).tolist()
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        at = 0
        # Suffixes before those of the bucket may belong to it too: they are the next generation.
        while at < len(larger[c]):
            now = larger[c][at] if at + 1 == len(larger[c]) else np.concatenate(larger[c][at:])
            at = len(larger[c])
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _dealt(before, s[before], larger)
        before = seeds[seeds_of[c] : seeds_of[c + 1]] - 1
        before = before[before >= 0]
        if len(before):
            _dealt(before, s[before], larger)
    whole = [np.concatenate(x) if x else none for x in larger]
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    smaller[0].append(np.array([len(s) - 1]))
    for c in range(size - 1, -1, -1):
        at = 0
        while at < len(smaller[c]):
            now = smaller[c][at] if at + 1 == len(smaller[c]) else np.concatenate(smaller[c][at:])
            at = len(smaller[c])
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _dealt(before, s[before], smaller)
        before = whole[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            _dealt(before, s[before], smaller)
    return np.concatenate([x for c in range(size) for x in (whole[c], *(y[::-1] for y in smaller[c][::-1]))])


def _by_suffix(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The same, one suffix after the other."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    order = np.full(len(s), -1, np.int64)
    own = s[seeds]
    behind = np.searchsorted(own, own, side="right") - np.arange(len(seeds))
    order[ends[own] - behind] = seeds
    symbols, is_small, out = s.tolist(), small.tolist(), order.tolist()
    free = (ends - counts).tolist()
    for i in range(len(out)):
        j = out[i] - 1
        if j >= 0 and not is_small[j]:
            c = symbols[j]
            out[free[c]] = j
            free[c] += 1
    free = ends.tolist()
    for i in range(len(out) - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and is_small[j]:
            c = symbols[j]
            free[c] -= 1
            out[free[c]] = j
    out[0] = len(out) - 1
    return np.array(out, np.int64)


def _induced(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    return (_by_bucket if size <= BUCKETS else _by_suffix)(s, small, seeds, size)


def _names(s: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of each leftmost smaller substring, in text order; equal substrings share one."""
    lengths = np.diff(np.r_[leftmost, len(s) - 1]) + 1
    number = np.empty(len(s), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    a, b = ordered[:-1], ordered[1:]
    sizes = lengths[number[a]]
    same = sizes == lengths[number[b]]
    pairs = np.flatnonzero(same)
    sizes = sizes[pairs]
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    differ = s[np.repeat(a[pairs], sizes) + inside] != s[np.repeat(b[pairs], sizes) + inside]
    same[pairs] = ~np.logical_or.reduceat(differ, ends - sizes) if len(pairs) else False
    rank = np.cumsum(np.r_[0, ~same])
    names = np.empty(len(leftmost), np.int64)
    names[number[ordered]] = rank
    return names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order.

    ``s`` holds whole numbers from 0 on; its last is 0 and no other is.
    """
    size = int(s.max(initial=0)) + 1
    if len(s) <= 1:
        return np.arange(len(s))
    # Small symbols are sorted by their digits.
    s = s.astype(np.uint16 if size <= BUCKETS else np.int32)
    small = smaller_than_next(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = leftmost[np.argsort(s[leftmost], kind="stable")]
    rough = _induced(s, small, seeds, size)
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    ordered = rough[is_leftmost[rough]]
    names = _names(s, leftmost, ordered)
    if int(names.max(initial=0)) + 1 < len(names):
        # The last substring is that of the end alone, so its name is 0 and no other's is.
        ordered = leftmost[suffix_array(names)]
    return _induced(s, small, ordered, size)


def permuted_common_prefix(s: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For every place, how far its suffix equals the one before it in ``order``, as far as the part it lies in.

    Parts begin at ``begins``. Where the symbols before two neighbours are equal too, the
    prefix is one less than that of the place before, so only the others are compared.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    starts = np.zeros(n, bool)
    starts[begins] = starts[0] = True
    heads = starts | (before <= 0)
    inner = np.flatnonzero(~heads)
    heads[inner] = (s[inner - 1] != s[before[inner] - 1]) | (before[inner - 1] != before[inner] - 1)
    at = np.flatnonzero(heads)
    stop = np.r_[begins[begins > 0], n][np.searchsorted(begins[begins > 0], at, side="right")]
    shared = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    step = 0
    while len(live):
        x, y = at[live] + step, before[at[live]] + step
        inside = (x < stop[live]) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[s[x] == s[y]]
        step += 1
        shared[live] = step
    head = np.cumsum(heads) - 1
    return np.maximum(shared[head] - (np.arange(n) - at[head]), 0)
