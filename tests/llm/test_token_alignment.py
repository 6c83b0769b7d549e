from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from velospan.llm import token_alignment as ta
from velospan.llm.queries import QUERIES

ODD = [
    None, "", " ", "  ", "a  b", " a", "a ", "a \n b", "x.\n y\n\nz \t q", "▁ x", "a▁b",
    "<|endoftext|> <s> <0x41> </s>", "日本 語 😀 é é", "a  b 　c", "\x85 x \x1c y ᠎ z ​k",
    "it's we'll 123456 , . !!! ---- ......", " " * 500, "\n" * 50, "﻿a ﻿b", "a\r\n b", "x\x00y", "ｆｕｌｌ width",
]


@pytest.fixture(scope="module")
def pair():
    return ta.TokenPair(ta.tokenizer_path(ta.BYTE_BPE), ta.tokenizer_path(ta.PIECE_BPE))


def whole(pair, text):
    """Ids of the whole text on both sides, and the bytes of each token; nothing where bytes differ."""
    if not text:
        return [], [], [], []
    a, b = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
    names = ta._byte_names()
    x = [bytes(names[c] for c in pair.first.id_to_token(i)) for i in a]
    y = [pair.second_bytes[i] for i in b]
    same = b"".join(x) == b"".join(y) == (" " + text).encode()
    return (a, b, x, y) if same else ([], [], [], [])


def groups_by_hand(pair, text):
    a, b, x, y = whole(pair, text)
    groups, left, right, at_a, at_b, j = [], [], [], 0, 0, 0
    for i, token in enumerate(a):
        left.append(token)
        at_a += len(x[i])
        while j < len(b) and at_b + len(y[j]) <= at_a:
            at_b += len(y[j])
            right.append(b[j])
            j += 1
        if at_a == at_b:
            groups.append((left, right))
            left, right = [], []
    assert not left and not right and j == len(b)
    return groups


def query_by_hand(pair, rows):
    groups = [groups_by_hand(pair, text) for _, text in rows]
    links = [Counter(p for left, right in g for p in product(left, right)) for g in groups]
    count = Counter(p for l in links for p in l)
    best: dict[int, int] = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for (doc_id, _), g, l in zip(rows, groups, links, strict=True):
        line = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        yield (
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(l.values()),
            sum(n for p, n in l.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in l.items()),
            hashlib.sha256(line.encode()).hexdigest() if line else "",
        )


def test_common_ends_equal_a_set_of_ends():
    rng = random.Random(1)
    for _ in range(5000):
        n, share = rng.randint(0, 40), rng.choice([0.1, 0.5, 0.9, 1.0])
        a, b = ([x for x in range(1, n + 1) if rng.random() < share or x == n] for _ in range(2))
        both = [x for x in a if x in set(b)]
        left, right = ta.common_ends(a, b)
        assert [a[i - 1] for i in left] == both and [b[i - 1] for i in right] == both


def test_long_stretches_and_long_groups():
    a = [*range(1, 100_001), 200_000, *range(200_001, 300_001)]
    b = [*range(1, 100_001), *range(100_002, 200_001), *range(200_001, 300_001)]
    left, right = ta.common_ends(a, b)
    assert len(left) == 200_001 and right[100_000] - left[100_000] == len(b) - len(a)


def test_tokens_by_parts_equal_those_of_whole_texts(pair):
    rng = random.Random(2)
    pieces = [" ", "  ", "\n", "\t", "a", "the", "'s", "日", "😀", "12", ".", " ", "᠎", "​", "▁", "é"]
    texts = ODD + ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(400)] + [prose(1, 300)]
    a, a_at, b, b_at = pair.tokens(texts)
    for i, text in enumerate(texts):
        want = whole(pair, text)
        assert a[a_at[i] : a_at[i + 1]].tolist() == want[0], repr(text)
        assert b[b_at[i] : b_at[i + 1]].tolist() == want[1], repr(text)


def test_forgetting_parts_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(ta, "KEPT_PARTS", 3)
    for seed in range(3):
        text = prose(seed, 50)
        a, _, b, _ = pair.tokens([text, text])
        assert (a.tolist(), b.tolist()) == tuple(x * 2 for x in whole(pair, text)[:2])


def test_query_equals_by_hand(spark, pair, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(i % 25, 40 + i % 7)) for i in range(60)]
    rows += [(None, prose(3, 43)), (7, "twice"), (7, "twice"), (8, "日本語" * 200), (9, "!" * 3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, query_by_hand(pair, rows)))


def test_large_groups_are_counted_by_distinct_ids(pair, monkeypatch):
    texts = [*ODD, "日本語" * 20, "!" * 300, prose(4, 60)]
    plain = [x.tolist() for x in ta._Groups(pair, texts).links(32_000)]
    monkeypatch.setattr(ta, "LARGE_GROUP", 0)
    assert [x.tolist() for x in ta._Groups(pair, texts).links(32_000)] == plain


def test_odd_and_empty_tables(spark, odd, nothing):
    assert ta.align(nothing).count() == 0
    clashing = odd.withColumn("block", F.lit(1)).withColumn("codes", F.lit("x")).withColumn("n_a", F.lit(0))
    got = ta.align(clashing)
    assert got.count() == odd.count() and got.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    row = got.filter("doc_id = 7").first()
    assert row["groups"].count(";") + 1 == row["n_groups"] and row["count_sum"] > 0
    assert got.filter("doc_id IN (3, 4)").select("n_links", "groups").distinct().collect() == [(0, "")]
