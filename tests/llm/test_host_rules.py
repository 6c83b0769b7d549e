from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, prose
from velospan.llm import host_rules

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def by_hand(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = len(covered)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed


def test_counts_equal_those_by_hand(spark, odd, odd_rows):
    extra = ["a b c a b c", "x y z x y z x y z x", "#*$ %&|\n#*$ %&|\n\n \n#*$ %&|", "a b c d b c d", "w w", "w w w", "w w w w"]
    more = spark.createDataFrame([(100 + i, x, "en", "z", 1) for i, x in enumerate(extra)], SCHEMA)
    got = sorted(map(repr, host_rules.host_rules(odd.union(more)).select(*COUNTS).collect()))
    from pyspark.sql import Row

    want = sorted(repr(Row(**dict(zip(COUNTS, by_hand(x), strict=True)))) for x in [*(r[1] for r in odd_rows), *extra])
    assert got == want


def test_rows_and_clashing_columns_come_back_once(odd, nothing):
    clash = odd.withColumn("kept", F.lit("old")).withColumn("_host", F.lit(1)).withColumn("n_words", F.lit(None))
    judged = host_rules.host_rules(clash)
    assert judged.count() == odd.count() and dict(judged.dtypes)["kept"] == "boolean" and "_host" in judged.columns
    kept = host_rules.keep_good(clash)
    assert kept.columns == clash.columns and kept.count() == judged.filter("kept").count() > 0
    assert host_rules.host_rules(nothing).count() == 0 and host_rules.keep_good(nothing).columns == nothing.columns


def test_a_host_of_failures_loses_its_good_document_too(spark):
    good, bad = prose(9, 200), "too short"
    rows = [(i, bad, "en", "junk", 1) for i in range(400)] + [(1000, good, "en", "junk", 1)]
    rows += [(2000 + i, prose(i, 200) if i % 10 else bad, "en", f"h{i % 4}", 1) for i in range(400)]
    kept = host_rules.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert kept.filter("source = 'junk'").count() == 0 and kept.filter("source <> 'junk'").count() == 360


def test_few_documents_are_not_judged_by_their_own_rate_alone(spark):
    hosts = spark.createDataFrame([("big", 10_000, 1000), ("other", 8000, 900), ("small", 2, 2)], "host string, n_docs bigint, n_failed bigint")
    rates = {r["host"]: r["rate"] for r in host_rules.host_verdicts(hosts).collect()}
    assert abs(rates["big"] - 0.1) < 0.01 and rates["small"] < 1
