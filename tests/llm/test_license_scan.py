from __future__ import annotations

import random
import re

import pytest

from tests.llm.conftest import prose
from velospan.llm import license_scan as scan
from pyspark.sql import functions as F


def base_by_hand(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_exact_places_are_all_found():
    rng = random.Random(2)
    pieces = ["cc by", "CC-BY", "General Public\tLicense", "all rights reserved", "all rights", "by", "cc", "éall rights reserved", "reserved.", "public license", "é", " "]
    for _ in range(2000):
        text = rng.choice([" ", "\n", "-"]).join(rng.choices(pieces, k=rng.randint(0, 12)))
        found = scan.scan_text(text)
        assert (found["n_words"], sorted((b["word"], b["label"]) for b in found["base"])) == base_by_hand(text)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("phrase", list(scan.NOTICES))
def test_every_notice_with_few_errors_is_found(phrase):
    rng = random.Random(phrase)
    allowed = min(scan.MOST_ERRORS, len(phrase) // scan.CHARS_AN_ERROR)
    for trial in range(60):
        changed = list(phrase)
        for _ in range(rng.randint(0, allowed)):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], ["q"], [changed[at], "w"]])
        changed = " ".join("".join(changed).split())
        if edits(changed, phrase) > allowed:
            continue
        found = scan.scan_text(f"{prose(trial, 40)} {changed.upper()} {prose(trial + 1, 40)}")
        assert scan.NOTICES[phrase] in {n["label"] for n in found["notices"]}, changed
        assert all(n["errors"] <= scan.MOST_ERRORS for n in found["notices"])


def test_parts_cover_a_phrase():
    for phrase in scan.NOTICES:
        for errors in range(5):
            parts = scan.seeds(phrase, errors)
            assert "".join(p for p, _ in parts) == phrase and len(parts) == errors + 1


def test_clean_prose_has_no_notice_and_spans_are_words():
    assert all(not scan.scan_text(prose(i, 400))["notices"] for i in range(40))
    text = "one two Licensd under the Apach License three"
    (found,) = scan.scan_text(text)["notices"]
    assert found["word"] == 2 and found["matched"] == "licensd under the apach license" and found["words"] == 5


def test_odd_rows(odd, odd_rows, nothing):
    scanned = scan.license_scan(odd.withColumn("license", F.lit("old")))
    digest = scanned.select("text", *[c.alias(n) for n, c in scan.digest("license").items()]).collect()
    assert len(digest) == len(odd_rows)
    for r in digest:
        n, places = base_by_hand(r["text"])
        assert (r["n_words"], r["n_base"]) == (n, len(places)) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert scan.license_scan(nothing).count() == 0
