"""Fuzzy search for short license notices in whole texts.

A notice found with at most k errors holds at least one of k + 1 parts of its phrase
unchanged. One automaton over all parts runs through a text once; every hit says
where its phrase would start, and only there does the regex library match the phrase
with a bounded number of errors. Exact base phrases come from the same hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.llm.columns import require

# The phrases whose exact places are counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices that are also found with errors.
NOTICES = {
    "all rights reserved": "reserved",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "dedicated to the public domain": "public-domain",
    "spdx license identifier": "spdx",
}
#: Characters of a phrase for each error that is allowed in it, and most errors.
CHARS_AN_ERROR, MOST_ERRORS = 8, 4

_FOUND = "array<struct<label: string, word: bigint, words: bigint, errors: bigint, matched: string>>"
_RESULT = f"struct<n_words: bigint, base: array<struct<label: string, word: bigint>>, notices: {_FOUND}>"

_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128)).lower()
_TABLE = {c: _ASCII[c] for c in range(128) if _ASCII[c] != chr(c)}


@dataclass(frozen=True)
class _Phrase:
    text: str
    label: str
    errors: int


def _phrases() -> list[_Phrase]:
    exact = [_Phrase(f" {p} ", label, 0) for p, label in BASE.items()]
    return exact + [_Phrase(p, label, min(MOST_ERRORS, len(p) // CHARS_AN_ERROR)) for p, label in NOTICES.items()]


def seeds(phrase: str, errors: int) -> list[tuple[str, int]]:
    """``errors + 1`` parts of a phrase of about equal length, with their places in it."""
    cuts = [round(i * len(phrase) / (errors + 1)) for i in range(errors + 2)]
    return [(phrase[low:high], low) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def _scanner():
    """The automaton over all parts, the phrases, and their patterns."""
    import ahocorasick
    import regex

    phrases = _phrases()
    owners: dict[str, list[tuple[int, int]]] = {}
    for number, phrase in enumerate(phrases):
        for part, at in seeds(phrase.text, phrase.errors):
            owners.setdefault(part, []).append((number, at))
    automaton = ahocorasick.Automaton()
    for part, owned in owners.items():
        automaton.add_word(part, (len(part), owned))
    automaton.make_automaton()
    patterns = [regex.compile(rf"(?b)(?:{p.text}){{e<={p.errors}}}") for p in phrases]
    return automaton, phrases, patterns


def normalized(text: str | None) -> str:
    """Words in lower case, one blank before and behind each; empty without words."""
    parts = [w for w in (text or "").translate(_TABLE).split(" ") if w]
    return f" {' '.join(parts)} " if parts else ""


class _Words:
    """Numbers of the words at ever larger places of a normalized text."""

    def __init__(self, line: str) -> None:
        self.line, self.at, self.seen = line, 0, -1

    def number(self, place: int) -> int:
        self.seen += self.line.count(" ", self.at, place)
        self.at = place
        return self.seen


def scan_text(text: str | None) -> dict:
    """``n_words``, every exact place of a base phrase, and every notice with at most its errors.

    Matches of one notice do not overlap. A match starts and ends at its nearest word
    boundaries, so a span is given in whole words.
    """
    automaton, phrases, patterns = _scanner()
    line = normalized(text)
    if not line:
        return {"n_words": 0, "base": [], "notices": []}
    starts: dict[int, set[int]] = {}
    for end, (length, owned) in automaton.iter(line):
        for number, at in owned:
            starts.setdefault(number, set()).add(end - length + 1 - at)
    base: list[tuple[int, str]] = []
    spans: list[tuple[int, int, str, int]] = []
    for number, places in starts.items():
        phrase = phrases[number]
        if not phrase.errors:
            base += [(place + 1, phrase.label) for place in places]
            continue
        upto = -1
        for place in sorted(places):
            low = max(0, place - phrase.errors)
            if place + len(phrase.text) <= upto:
                continue
            window = line[max(low, upto) : place + len(phrase.text) + phrase.errors]
            match = patterns[number].search(window)
            if match is None:
                continue
            first = max(low, upto) + match.start()
            last = max(low, upto) + match.end()
            spans.append((first, last, phrase.label, sum(match.fuzzy_counts)))
            upto = last
    words = _Words(line)
    found = [{"label": label, "word": words.number(place)} for place, label in sorted(base)]
    words, notices = _Words(line), []
    for first, last, label, errors in sorted(spans):
        begin = line.rfind(" ", 0, first + 1) if line[first] != " " else first
        begin, end = max(begin, 0), line.find(" ", last - 1)
        matched = line[begin:end].strip()
        notices.append({
            "label": label,
            "word": words.number(begin + 1),
            "words": matched.count(" ") + 1,
            "errors": errors,
            "matched": matched,
        })
    return {"n_words": line.count(" ") - 1, "base": found, "notices": notices}


def scan(text: Column) -> Column:
    """A struct of ``n_words``, ``base`` and ``notices`` for a column of texts; null is empty."""
    kind = T._parse_datatype_string(_RESULT)

    @F.arrow_udf(kind)
    def scanned(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([scan_text(x) for x in texts.to_pylist()], to_arrow_type(kind))

    return scanned(text.cast("string"))


def license_scan(docs: DataFrame, text: str = "text", name: str = "license") -> DataFrame:
    """``docs`` with one more column ``name``: what ``scan`` finds in each row's whole text.

    A column of that name is replaced. Null and empty texts have no words and no
    finds; repeated rows have the same finds; an empty table gives an empty table.
    """
    return require(docs, text).withColumn(name, scan(F.col(text)))


def digest(found: str) -> dict[str, Column]:
    """Counts, first and last word, labels and a score of a struct made by ``scan``.

    The score is 1 where a base phrase stands, else the best notice's share of right
    characters; 0 without any.
    """
    base, notices = F.col(f"{found}.base"), F.col(f"{found}.notices")
    places = F.transform(base, lambda b: b["word"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    labels = F.array_union(base_labels, F.transform(notices, lambda n: n["label"]))
    right = F.transform(notices, lambda n: 1 - n["errors"] / F.greatest(F.length(n["matched"]), F.lit(1)))
    best = F.coalesce(F.array_max(right), F.lit(0.0))
    return {
        "n_words": F.col(f"{found}.n_words"),
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(places),
        "last_word": F.array_max(places),
        "base_labels": F.array_join(base_labels, ","),
        "labels": F.array_join(F.array_sort(labels), ","),
        "score": F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0))),
    }
