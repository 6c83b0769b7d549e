from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, prose
from velospan.llm import sketch


def paragraphs(text):
    pattern = rf"[^\n]{{1,{sketch.PARAGRAPH_CHARS - 1}}}[.!?](?=[\x20\x09-\x0D]|$)|[^\n]{{1,{sketch.PARAGRAPH_CHARS}}}"
    return {p.strip(" \t\n\x0b\x0c\r") for p in re.findall(pattern, text)} - {""}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def by_hand(rows):
    texts = [r[1] or "" for r in rows]
    out = []
    for i, own in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        out.append((rows[i][0], len(own), hashlib.sha256(edited.encode()).hexdigest(), round(alike(own, edited), 9), round(alike(own, after), 9)))
    return out


def run(docs):
    got = sketch.document_sketches(docs).collect()
    return got, [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]


def test_recovered_differences_and_edits(spark):
    rng = random.Random(1)
    rows = [(i, prose(i % 50, rng.randint(0, 400)) or None, "en", "a", 1) for i in range(150)]
    rows += [(500, prose(1, 20_000), "en", "a", 1), (501, prose(1, 20_000) + " x", "en", "a", 1), (502, "é😀", "en", "a", 1)]
    _, got = run(spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("row", F.lit(1)))
    assert sorted(got) == sorted(by_hand(rows))


def test_equal_texts_have_equal_prints_and_others_do_not(spark, odd, odd_rows, nothing):
    got, _ = run(odd)
    assert len(got) == len(odd_rows)
    texts = {}
    known = {(r[0], len(r[1] or "")): r[1] or "" for r in odd_rows}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        texts.setdefault(known[r["doc_id"], r["n_chars"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in texts.values())
    worded = [x.pop() for t, x in texts.items() if paragraphs(t)]
    assert len(set(worded)) == len(worded)
    assert run(nothing)[0] == []


def test_copies_follow_one_another_and_one_row_follows_itself(spark):
    rows = [(1, "a b c d", "en", "a", 1)] * 3 + [(2, "w x y z", "en", "a", 1)]
    assert sorted(run(spark.createDataFrame(rows, SCHEMA))[1]) == sorted(by_hand(rows))
    assert run(spark.createDataFrame(rows[:1], SCHEMA))[1] == by_hand(rows[:1])


def test_small_tables_are_enlarged_until_all_is_recovered(spark, monkeypatch):
    monkeypatch.setattr(sketch, "ROUNDS", 1)
    rng = random.Random(2)
    sets = []
    for i in range(200):
        both = rng.sample(range(-(10**15), 10**15), 60)
        a, b = rng.randint(0, 30), rng.randint(0, 30)
        shared = both[30 : 30 + b]
        sets.append((i, "w", both[:a] + shared, list(dict.fromkeys(both[a : a + 5] + shared))))
    pairs = spark.createDataFrame(sets, "row bigint, which string, first array<bigint>, second array<bigint>")
    got = {r["row"]: (r["a"], r["b"]) for r in sketch.differences(pairs).collect()}
    assert got == {i: (len(set(x) - set(y)), len(set(y) - set(x))) for i, _, x, y in sets}
