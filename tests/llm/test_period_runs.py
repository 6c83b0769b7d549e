from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA
from velospan.llm import period_runs
from velospan.llm.columns import whole_text, words
from velospan.llm.queries import QUERIES


def by_hand(w, least_length=6, least_exponent=4):
    """(start, length, period) of all runs: every stretch of places that equal those a period on."""
    shortest = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            start = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i > start and i - start >= p:
                shortest.setdefault((start, i - start + p), p)
            i += i == start
    return sorted((s, n, p) for (s, n), p in shortest.items() if n >= max(least_length, least_exponent * p))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng):
    n, k = rng.choice([0, 1, 2, 6, 40, 120]), rng.choice([1, 2, 3, 40])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), 1 + n // rng.randint(2, 12)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("least_length,least_exponent", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_those_by_hand(least_length, least_exponent):
    rng = random.Random(least_exponent)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        codes = np.array([int(x[1:]) for w in texts for x in w], np.int64)
        got = period_runs.find_runs(codes, np.cumsum([0, *map(len, texts)]), least_length, least_exponent)
        want = [(t, *r) for t, w in enumerate(texts) for r in by_hand(w, least_length, least_exponent)]
        assert [tuple(map(int, r)) for r in got] == want


def test_suffixes_are_in_order():
    rng = np.random.default_rng(3)
    w, text = rng.integers(0, 3, 200), np.repeat(np.arange(4), 50)
    order, _ = period_runs.suffix_array(w, text)
    tails = [(text[i], *w[i : 50 * (text[i] + 1)]) for i in order]
    assert tails == sorted(tails)


@pytest.mark.parametrize("texts", [["a"] * 200_000, ["a", "b"] * 100_000, [f"w{i}" for i in range(1000)] * 200])
def test_very_long_periodic_texts(texts):
    codes = np.unique(texts, return_inverse=True)[1]
    (run,) = period_runs.find_runs(codes.astype(np.int64), np.array([0, len(codes)]))
    assert tuple(run) == (0, 0, 200_000, len(set(texts)))


def test_slices_do_not_change_results(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    lists = pa.array([*(some_words(rng) for _ in range(40)), None, []], pa.list_(pa.string()))
    whole = period_runs._batch(lists, 6, 4).to_pylist()
    monkeypatch.setattr(period_runs, "SLICE_WORDS", 50)
    monkeypatch.setattr(period_runs, "TESTED_AT_ONCE", 7)
    assert period_runs._batch(lists, 6, 4).to_pylist() == whole
    assert period_runs._batch(lists.slice(5, 20), 6, 4).to_pylist() == whole[5:25]
    for w, row in zip(lists.to_pylist(), whole, strict=True):
        runs = by_hand(w or [])
        assert [tuple(r.values()) for r in row["runs"]] == runs
        assert row["collapsed"] == collapsed(w or [], runs) and row["n_words"] == len(w or [])


def query_by_hand(doc_id, text):
    w = [x for x in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = by_hand(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), collapsed(w, runs))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *digests)


def test_query_equals_by_hand(spark, odd_rows, tmp_path):
    rng = random.Random(5)
    rows = [r for r in odd_rows if r[0] != 6] + [(i, " ".join(some_words(rng)), "en", "s", 1) for i in range(100, 260)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_period_runs"](spark, str(tmp_path))
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    want = [query_by_hand(r[0], r[1]) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 40


def test_odd_and_empty_tables(spark, odd, nothing):
    split = words(whole_text())
    assert period_runs.with_runs(nothing, split).count() == 0
    # A column of the result's name is replaced, others stay.
    kept = period_runs.with_runs(odd.withColumn("periodic", F.lit(1)).withColumn("runs", F.lit(2)), split)
    assert kept.columns == [*odd.columns, "periodic", "runs"] and kept.count() == odd.count()
    long = kept.filter("doc_id = 6").select("periodic.*").first()
    assert long["n_words"] == 30_000 and long["runs"] == []
    with pytest.raises(ValueError):
        period_runs.with_runs(odd, split, least_exponent=1)
