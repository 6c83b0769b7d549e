from __future__ import annotations

import random
import zlib

import numpy as np

from tests.llm.conftest import SCHEMA, prose
from velospan.llm import toxicity
from velospan.llm.queries import QUERIES


def test_pairs_of_terms_are_learnt():
    """Label 1 needs both of two terms: no sum of weights for each can say so."""
    rng = random.Random(3)
    lists, labels = [], []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        lists.append(np.array([1] * a + [2] * b + rng.sample(range(10, 60), 8)))
        labels.append(int(a == b))
    model = toxicity.fit(lists, np.array(labels))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    right = ((model.logits(np.concatenate(lists), starts) > 0) == np.array(labels, bool)).mean()
    assert right > 0.9


def test_scores_by_formula():
    model = toxicity.Model(-1.0, np.array([3, 5]), np.array([0.5, 2.0]), np.array([[1.0, 0.5], [2.0, -1.0]]))
    values, starts = np.array([3, 5, 9, 5]), np.array([0, 3, 4, 4])
    assert np.allclose(model.logits(values, starts), [-1 + 2.5 + (2.0 - 0.5), 1.0, -1.0])


def test_held_out_documents_of_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    judged = QUERIES["op2_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in judged["doc_id"]] == judged["held_out"].tolist()
    held = judged[judged["held_out"]]
    toxic = held[held["toxic"] == 1]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert toxic["predicted"].mean() > 0.85 and held[held["toxic"] == 0]["predicted"].mean() < 0.01
    assert ((judged["score"] >= 0.5) == (judged["predicted"] == 1)).all()


def test_odd_rows_and_labels(spark, odd, nothing):
    few = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    clash = odd.withColumnRenamed("lang", "score")
    judged = toxicity.toxicity(clash, few)
    assert judged.count() == odd.count() and judged.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(nothing, few).count() == 0
    unlabelled = toxicity.toxicity(odd, few.limit(0))
    assert {r["score"] for r in unlabelled.select("score").collect()} == {0.5}
    kept = toxicity.keep_civil(odd, few)
    assert kept.columns == odd.columns


def test_toxic_documents_go_and_clean_ones_stay(spark):
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = prose(i, 60) + (f" {bad[i % 3]} {bad[(i + 1) % 3]}" if toxic else "")
        rows.append((i, text, "en", "a", 1))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = toxicity.keep_civil(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 4}
