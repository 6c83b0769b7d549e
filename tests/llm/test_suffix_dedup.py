from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from velospan.llm import induced_sort, suffix_dedup
from velospan.llm.queries import QUERIES


def by_hand(texts, length):
    """Maximal stretches covered by strings that stand twice, by counting every string."""
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        spans: list[list[int]] = []
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(x for s in spans for x in s), len(t)]
        yield len(t), spans, b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


@pytest.mark.parametrize("buckets", [0, 3, 1024])
def test_suffix_arrays_and_prefixes_equal_sorting(monkeypatch, buckets):
    monkeypatch.setattr(induced_sort, "BUCKETS", buckets)
    rng = random.Random(buckets)
    for _ in range(400):
        n, k = rng.choice([0, 1, 2, 8, 60, 200]), rng.choice([1, 2, 3, 300])
        x = [rng.randint(1, k) for _ in range(n)] * rng.randint(1, 3)
        s = np.array([*x, 0])
        order = induced_sort.suffix_array(s)
        tails = s.tolist()
        assert order.tolist() == sorted(range(len(s)), key=lambda i: tails[i:])
        begins = np.array(sorted({0, rng.randrange(len(s)), rng.randrange(len(s))}))
        prefix = induced_sort.permuted_common_prefix(s, order, begins)
        for rank, i in enumerate(order.tolist()):
            stop = min([b for b in begins.tolist() if b > i] + [len(s)])
            shared, j = 0, order[rank - 1]
            while rank and i + shared < stop and j + shared < len(s) and tails[i + shared] == tails[j + shared]:
                shared += 1
            assert prefix[i] == shared


def test_equal_strings_have_equal_anchors(monkeypatch):
    rng, length = random.Random(3), 60
    shared = bytes(rng.choices(b"ab", k=300))
    seen: dict[bytes, tuple] = {}
    for chunk in (suffix_dedup.CHUNK, 150):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        monkeypatch.setattr(suffix_dedup, "LENGTH", length)
        suffix_dedup._powers.cache_clear()
        for _ in range(10):
            text = bytes(rng.choices(b"abc", k=rng.randint(0, 200))) + shared + bytes(rng.choices(b"abc", k=50))
            first, count, at, anchor = suffix_dedup.segments(text, length, gram=12)
            assert count.sum() == len(text) - length + 1 and (np.diff(first) == count[:-1]).all()
            for f, c, a, h in zip(first, count, at, anchor, strict=True):
                for i in range(c):
                    assert 0 <= a - i <= length - 12
                    assert seen.setdefault(text[f + i : f + i + length], (a - i, h)) == (a - i, h)
    monkeypatch.undo()
    suffix_dedup._powers.cache_clear()


def corpus():
    rng = random.Random(8)
    line = prose(77, 90) + " é日"
    texts = [prose(i, 150) for i in range(12)]
    texts += [texts[0], texts[0], texts[1] + " more", texts[2][:500] + "X" + texts[2][501:]]
    texts += [prose(50 + i, rng.randint(5, 90)) + line + prose(90 + i, rng.randint(0, 60)) for i in range(30)]
    # A passage just too short, one just long enough, periodic texts, and a text that repeats itself.
    short, enough = prose(70, 200)[:399], prose(71, 200)[:400]
    texts += [f"a{i}{short}b{i}" for i in range(3)] + [f"a{i}{enough}b{i}" for i in range(3)]
    texts += ["ab" * 700, "a" * 2500, "x" + "ab" * 650, line + " middle " + line, None, "", "é" * 199, "é" * 200, "日" * 300]
    near = list(prose(60, 160))
    for i in range(40):
        copy = near.copy()
        for _ in range(3):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    return [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts, 1)]


@pytest.mark.parametrize("crowd,shard", [(1024, 1 << 20), (1, 4000), (20, 1 << 14)])
def test_query_equals_counting_all_strings(spark, tmp_path, monkeypatch, crowd, shard):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [
        (r[0], n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for r, (n, spans, kept) in zip(rows, by_hand([(r[1] or "").encode() for r in rows], 400), strict=True)
    ]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[2] > 0 for w in want) > 60


def test_other_lengths_keep_columns(spark):
    texts = [prose(i % 4, 40)[i : 150 + i] for i in range(30)]
    docs = spark.createDataFrame([(i, t, "t1", "x") for i, t in enumerate(texts)], "first int, body string, t1 string, spans string")
    got = suffix_dedup.without_repeats(docs, text="body", name="spans", length=64)
    assert got.columns == ["first", "body", "t1", "spans"] and got.count() == 30
    want = dict(enumerate(by_hand([t.encode() for t in texts], 64)))
    for r in got.collect():
        n, spans, kept = want[r["first"]]
        assert (r["spans"]["n_bytes"], [list(s) for s in r["spans"]["spans"]], bytes(r["spans"]["kept"])) == (n, spans, kept)
        assert r["t1"] == "t1"
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(docs, text="body", length=48)


def test_odd_and_empty_tables(spark, odd, nothing):
    assert suffix_dedup.without_repeats(nothing).count() == 0
    got = suffix_dedup.without_repeats(odd.withColumn("t1", F.lit(0)))
    kept = {(r["doc_id"], r["repeats"]["n_bytes"], len(r["repeats"]["kept"])) for r in got.filter("doc_id > 1").collect()}
    assert got.count() == odd.count() and (3, 0, 0) in kept and all(n == k for i, n, k in kept if i != 2)
    assert {k for i, n, k in kept if i == 2} == {0}
