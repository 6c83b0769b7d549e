from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, prose
from velospan.llm import lsh_forest
from velospan.llm.components import components


def shingles(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    """Size of the set and least id of the component of every row."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label, strict=True):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    return [(r[0], len(s), r[0] if not s else least.get(x)) for r, s, x in zip(rows, sets, label, strict=True)]


def near_copies(seed, n, words=120, first=1000):
    """A base text and copies of it with a few words changed, some of them chained."""
    rng = random.Random(seed)
    base = prose(seed, words).split(" ")
    rows = []
    for i in range(n):
        copy = base[:]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(words)] = f"w{rng.randrange(1000)}"
        rows.append((first + i, " ".join(copy), "en", "a", 1))
    return rows


def judged(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return lsh_forest.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()


def test_components_equal_those_of_all_pairs(spark, odd_rows):
    rows = odd_rows + near_copies(1, 60) + near_copies(2, 25, 30, 2000) + [(3000 + i, prose(50 + i, 90), "en", "a", 1) for i in range(60)]
    rows += [(4000, "four little words only", "en", "a", 1), (4001, "FOUR little words\nonly", "en", "a", 1), (4002, "only four", "en", "a", 1)]
    got = judged(spark, rows)
    assert sorted(map(repr, by_hand(rows))) == sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    for r in got:
        assert r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"])


def test_large_clusters_are_compared_by_region(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "CLUSTER_NODES", 20)
    rows = near_copies(3, 150) + near_copies(4, 10, first=5000)
    got = judged(spark, rows)
    assert sorted(map(repr, by_hand(rows))) == sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)


def test_regions_deepen_only_where_crowded():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 255, (400, lsh_forest.VALUES)).astype(np.uint8)
    keys[:300, :6] = 7
    keys[300:310] = keys[300]
    keys = np.array(sorted(keys.tolist()), np.uint8)
    shared = lsh_forest._common_prefix(keys, np.zeros(len(keys)))
    region = lsh_forest._regions(shared, 64)
    assert np.bincount(region).max() <= 64
    tail = np.flatnonzero((keys[:, :2] != 7).any(axis=1))
    for i, j in zip(tail, tail[1:]):
        assert (region[i] == region[j]) == (j == i + 1 and (keys[i, :2] == keys[j, :2]).all())


def test_equal_signatures_beyond_a_region_stay_tied():
    import pyarrow as pa

    n = lsh_forest.REGION * 2 + 5
    node = pa.array([i.to_bytes(16, "big") for i in range(n)])
    batch = pa.RecordBatch.from_arrays([node, pa.array([0] * n, pa.int32()), pa.array([bytes(64)] * n)], names=["node", "tree", "key"])
    (made,) = lsh_forest._groups_of(iter([batch]))
    parent = {x: x for x in node.to_pylist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for first, member in zip(made["first"].to_pylist(), made["node"].to_pylist(), strict=True):
        parent[find(member)] = find(first)
    assert len({find(x) for x in parent}) == 1


def test_one_row_of_each_group_stays(spark, odd_rows, nothing):
    rows = odd_rows + near_copies(1, 30)
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", root string")
    kept = lsh_forest.without_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if shingles(r["text"])]
    want = {(c if c is not None else None) for _, n, c in by_hand(rows) if n}
    assert sorted(x for x in set(ids) if x) == sorted(x for x in want if x)
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(9) == 2
    blank = [r for r in rows if not shingles(r[1])]
    assert sum(not shingles(r["text"]) for r in kept.collect()) == len(blank)
    assert lsh_forest.near_duplicates(nothing).count() == 0 and lsh_forest.without_duplicates(nothing).count() == 0


def test_copies_alone_leave_one(spark):
    docs = spark.createDataFrame([(i // 2, prose(1, 100), "en", "a", 1) for i in range(40)], SCHEMA)
    assert lsh_forest.without_duplicates(docs).count() == 1


def test_components_of_chains_stars_and_loops(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {f"c{i:03}": "c000" for i in range(1, 41)} | {f"s{i}": "hub" for i in range(50)}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def star(seed, leaves, words=200):
    """An original and copies with three of its words changed: each is near the original, hardly any near another."""
    rng = random.Random(seed)
    base = prose(seed, words).split(" ")
    rows = [(leaves, " ".join(base), "en", "a", 1)]
    for i in range(leaves):
        copy = base[:]
        for at in rng.sample(range(5, words - 5, 5), 3):
            copy[at] = f"x{i}x{at}"
        rows.append((i, " ".join(copy), "en", "a", 1))
    return rows


def linked_by_hand(rows, percent=85):
    """Pairs of rows that are linked, by the shingles that more than one row holds."""
    sets = [shingles(r[1]) for r in rows]
    times = Counter(x for s in sets for x in s)
    column = {x: i for i, x in enumerate(x for x, k in times.items() if k > 1)}
    held = np.zeros((len(rows), len(column)), np.float32)
    for i, s in enumerate(sets):
        held[i, [column[x] for x in s if x in column]] = 1
    shared, sizes = held @ held.T, np.array([len(s) for s in sets])
    return 100 * shared >= percent * (sizes[:, None] + sizes - shared)


def test_a_star_beyond_a_region_is_one_component(spark):
    rows = star(11, 3000)
    linked = linked_by_hand(rows)
    assert linked[0].all() and linked[1:, 1:].sum() < 1.5 * 3000
    assert {r["component_id"] for r in judged(spark, rows)} == {0}


def test_crowded_sets_without_links_stay_apart(spark):
    rows = star(12, 700)[1:]
    linked, label = linked_by_hand(rows), list(range(700))
    for i, j in zip(*np.nonzero(np.tril(linked, -1)), strict=True):
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert len(set(label)) > 600
    assert [r["component_id"] for r in sorted(judged(spark, rows))] == label


def family(seed, copies, words=200, changed=5):
    """Copies of a text that is not there, each with some words of its own: near one another, but none linked."""
    rng = random.Random(seed)
    base = prose(seed, words).split(" ")
    rows = []
    for i in range(copies):
        copy = base[:]
        for at in rng.sample(range(5, words - 5, 5), changed):
            copy[at] = f"y{i}y{at}"
        rows.append((i, " ".join(copy), "en", "a", 1))
    return rows


def as_sets(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    described = docs.select("doc_id", F.format_string("%09d", "doc_id").cast("binary").alias("node"), lsh_forest._set_bytes(lsh_forest.word_hashes("text")).alias("shingles"))
    return described.localCheckpoint()


def test_sets_that_cannot_be_linked_make_no_pairs(spark, monkeypatch):
    rows = family(21, 150)
    assert linked_by_hand(rows).sum() == 0
    made, plain = [], lsh_forest._pair_links

    def counted(pairs, *more):
        made.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(lsh_forest, "_pair_links", counted)
    none = spark.createDataFrame([], "a binary, b binary")
    assert lsh_forest.parted_links(as_sets(spark, rows), none).count() == 0
    # Their rarest shingles hold some that all share, but too few follow these: before, all 11,000 pairs were made.
    assert made[0] <= 150 * 40 and made[1] == 0


def test_places_of_the_rarest_shingles_are_those_of_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_SHINGLES", 700)
    rows = near_copies(22, 40) + star(23, 20, 60)
    table = as_sets(spark, [(i, *r[1:]) for i, r in enumerate(rows)], 7)
    sets = {r["node"]: np.frombuffer(r["shingles"], np.int64) for r in table.collect()}
    times = Counter(x for s in sets.values() for x in s.tolist())
    want = set()
    for node, s in sets.items():
        order = sorted(s.tolist(), key=lambda x: (times[x], x))
        want |= {(bytes(node), len(s), i, x) for i, x in enumerate(order[: len(s) - -(-len(s) * 85 // 100) + 1]) if times[x] > 1}
    got = lsh_forest._rarest(table, 85).collect()
    assert {(bytes(r["node"]), r["n"], r["at"], r["shingle"]) for r in got} == want and len(got) == len(want)
