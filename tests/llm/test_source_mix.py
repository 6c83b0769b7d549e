from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import pytest

from tests.llm.conftest import SCHEMA, prose
from velospan.llm import source_mix


def targets_by_hand(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, Fraction(sum(sizes.values()))
    free = set(order)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: Fraction(3 * sizes[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("rows", [
    {"a": 100, "b": 5, "c": 1000, "d": 7, None: 60, "é": 0},
    {"a": 1, "b": 1, "c": 1},
    {"z": 10},
    {"a": 0, "b": 0},
])
def test_targets_are_shared_up_to_the_cap(spark, rows):
    table = spark.createDataFrame(list(rows.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_mix.source_targets(table).collect()}
    want = targets_by_hand(rows)
    assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-6 for s in want)


def test_each_source_meets_its_target(spark, odd, odd_rows, nothing):
    rows = odd_rows + [(1000 + i, prose(i, 20 + i % 90), "en", f"s{i % 5}", 1) for i in range(400)]
    mixed = source_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(mixed) == len(rows)
    taken, target = defaultdict(int), {}
    for r in mixed:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for source, words in taken.items():
        # Rows that share an id at the threshold lose less than a word each.
        assert abs(words - target[source]) <= 3, source
    again = source_mix.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, again))
    assert source_mix.mix(nothing).count() == 0


def test_the_mix_holds_the_words_it_takes(spark, odd_rows, nothing):
    rows = odd_rows + [(1000 + i, prose(i, 20 + i % 90), "en", f"s{i % 5}", 1) for i in range(200)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", take string")
    taken = defaultdict(int)
    for r in source_mix.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
        assert any(t is not None and t.startswith(r["text"].rstrip()) for t in texts[r["doc_id"]])
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert source_mix.mixed_documents(nothing).count() == 0
