from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_host_rules import by_hand as counts_by_hand
from tests.llm.test_lsh_forest import by_hand as components_by_hand
from tests.llm.test_lsh_forest import shingles
from tests.llm.test_packing import whole_ids
from velospan.llm import source_mix
from velospan.staging import staged

BAD = ["idiot", "moron", "scum", "loser"]


def corpus():
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        text = prose(i, 60 + i % 50) + (f" {BAD[i % 4]} so {BAD[(i + 1) % 4]}" if toxic else "")
        rows.append((i, "short text" if i % 23 == 3 else text, "en", f"s{i % 4}" if i % 9 else None, 1))
        labels.append((i, int(toxic)))
    copies = [(1000 + i, rows[i][1] + " more", "en", "s1", 1) for i in range(0, 200, 7)]
    odd = [(2000, None, "en", "s0", 0), (2001, "", None, None, 0), (None, prose(900, 80), "en", "s2", 1), (7, rows[7][1], "en", "s3", 1)]
    return rows + copies + odd, labels


def test_stages_equal_what_each_should_do(spark, tmp_path):
    rows, labels = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        seen.append([tuple(r) for r in docs.collect()])
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, civil, single, mixed, packed = seen
    good = [r for r in rows if not counts_by_hand(r[1])[5]]
    assert sorted(map(repr, quality)) == sorted(map(repr, good))
    clean = [r for r in quality if not set(r[1].split()) & set(BAD)]
    assert sorted(map(repr, civil)) == sorted(map(repr, clean))
    want = {c for _, _, c in components_by_hand(civil)}
    assert sorted((r[0] or -1) for r in single) == sorted((c or -1) for c in want)
    taken = sum(r["taken"] for r in source_mix.mix(spark.createDataFrame(single, SCHEMA)).collect())
    assert sum(len(r[1].split()) for r in mixed) == taken
    crcs = []
    for ids in whole_ids(r[1] for r in mixed):
        ids = np.array([*ids, 0], "<u4")
        crcs += [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    assert sorted(r[4] for r in packed) == sorted(crcs)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(r[4] for r in again.collect()) == sorted(crcs) and again.columns == docs.columns


def test_near_dedup_links_from_four_fifths_on(spark, tmp_path):
    rows = []
    for i in range(30):
        words = prose(5000 + i, 100).split(" ")
        # One word changed in the middle and 5 to 14 more at the end: from 0.86 down to 0.79.
        copy = [*words[:50], "changed", *words[51:], *[f"end{k}" for k in range(5 + i % 10)]]
        rows += [(10 * i, " ".join(words), "en", "s", 1), (10 * i + 1, " ".join(copy), "en", "s", 1)]
    linked = [row[0] for base, row in zip(rows[::2], rows[1::2]) if near(base, row, 80)]
    assert any(not near(rows[2 * i], rows[2 * i + 1], 85) for i in range(30) if 10 * i + 1 in linked)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - set(linked) and 0 < len(linked) < 30


def near(a, b, percent):
    x, y = shingles(a[1]), shingles(b[1])
    return 100 * len(x & y) >= percent * len(x | y)


def test_queries_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert {"op4_preference", "op8_source_mix", "op10_host_rules", "op11_period_runs"} <= set(contract.oracle_sql())


def test_empty_tables_and_more_columns(spark, tmp_path):
    names = "doc_id bigint, toxic int"
    for number, (rows, labels) in enumerate([([], []), ([(1, prose(1, 80), "en", "s", 1), (2, prose(2, 80), "en", "s", 1)], [])]):
        folder = f"{tmp_path}/{number}"
        docs = spark.createDataFrame(rows, SCHEMA)
        # Names that stages use for columns of their own.
        more = {c: F.lit(7) for c in ("score", "size", "block", "node", "n", "terms", "taken", "kept", "host_kept", "root")}
        docs.withColumns(more).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, names).write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder)
        want = [len(ids) + 1 for ids in whole_ids(r[1] for r in rows)]
        assert sorted(r["length"] for r in packed.collect()) == sorted(want)
