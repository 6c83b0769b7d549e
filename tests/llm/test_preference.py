from __future__ import annotations

from pyspark.sql import functions as F
from velospan.llm import preference

TURNS = "array<struct<role: string, text: string>>"


def shown(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def spans(turns):
    at, found = 0, []
    for role, text in turns:
        begin = at + len(f"<|{role or ''}|>\n")
        at = begin + len(text or "") + len("<|end|>\n")
        if role == "assistant":
            found.append((begin, at))
    return found


def test_examples_equal_those_by_hand(spark):
    u, a, b, s = ("user", "hi é😀"), ("assistant", "yes"), ("assistant", "no"), ("system", None)
    cases = [
        ([u, a], [u, b]), ([u, a, u, b], [u, a, u, a, u]), ([], []), ([u], []), ([], [b]), ([u, a], [u, a]),
        ([s, u, a], [s, u]), ([(None, None)], [("", "")]), ([a, b, a], [b]), ([u] * 60 + [a], [u] * 60 + [b]),
    ]
    rows = [(i, c, r, "kept") for i, (c, r) in enumerate(cases)] + [(99, None, [u], "kept"), (0, *cases[0], "kept")]
    pairs = spark.createDataFrame(rows, f"id int, chosen {TURNS}, rejected {TURNS}, prompt string")
    got = preference.format_preferences(pairs.drop("prompt").withColumn("extra", F.lit(1)))
    assert got.count() == len(rows)
    for r in got.collect():
        c, j = ([(x or "", y or "") for x, y in t or []] for t in rows[[x[0] for x in rows].index(r["id"])][1:3])
        k = next((i for i, (x, y) in enumerate(zip(c, j)) if x != y), min(len(c), len(j)))
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (k, shown(c[:k]), shown(c[k:]), shown(j[k:]))
        assert [tuple(x) for x in r["chosen_mask"]] == spans(c[k:]) and [tuple(x) for x in r["rejected_mask"]] == spans(j[k:])


def test_neighbours_lend_their_last_reply(spark):
    rows = [
        (2, 0, "user", "q"), (2, 1, "assistant", "a2"), (2, 2, "user", "thanks"), (3, 0, "assistant", "first"), (3, 1, "assistant", "a3"),
        (4, 0, "user", "no reply"), (5, 0, "user", "q5"), (5, 1, "assistant", "a5"), (None, 0, "user", "lost"), (8, None, None, None),
        (8, 1, "assistant", None), (8, 1, "assistant", None),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, turns string")
    made = preference.format_preferences(preference.swapped_replies(preference.whole_conversations(turns)))
    got = {r["conv_id"]: r for r in made.collect()}
    assert set(got) == {2, 3, 4, 5, 8}
    assert got[2]["prompt"] == shown([("user", "q")]) and got[2]["chosen"] == shown([("assistant", "a2")]) and got[2]["rejected"] == shown([("assistant", "a3")])
    assert got[3]["n_prompt_turns"] == 1 and got[3]["rejected"] == shown([("assistant", "a2")])
    assert got[4]["prompt"] == shown([("user", "no reply")]) and got[4]["chosen"] == got[4]["rejected"] == ""
    assert got[5]["rejected"] == "" and got[5]["chosen"] == shown([("assistant", "a5")])
    assert got[8]["n_prompt_turns"] == 2
    assert preference.whole_conversations(turns.limit(0)).count() == 0
