"""Preference examples: one prompt, a chosen and a rejected completion, and what to train on.

Two versions of a conversation are compared turn by turn; the longest run of equal
turns at their beginning is rendered once as the prompt, the rest of each as its
completion. A mask lists the spans of a completion, in characters, that an assistant
wrote. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velospan.llm.columns import require

# How a turn is written.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"

_TURN = "struct<role: string, text: string>"


def _named(turn: Column) -> Column:
    """A turn without nulls."""
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    return F.struct(role.alias("role"), text.alias("text"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """``start`` and ``stop`` of every assistant turn's text and end mark in the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(_header(turn))
        stop = begin + F.length(turn["text"]) + len(END)
        span = F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop"))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(stop.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from their beginning on, by role and text."""
    least = F.least(F.size(a), F.size(b))
    parted = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(parted == 0, least).otherwise(F.least(parted.cast("int") - 1, least))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two columns of turns (arrays of ``role`` and ``text``) by a formatted example.

    New columns: ``n_prompt_turns``, ``prompt``, ``chosen``, ``rejected``, ``chosen_mask``,
    ``rejected_mask``; columns so named are replaced. Null roles and texts are empty, a
    null conversation has no turns. Equal conversations are all prompt and leave two
    empty completions; repeated rows stay.
    """
    require(pairs, chosen, rejected)
    kind = f"array<{_TURN}>"
    a, b = (F.transform(F.coalesce(F.col(c).cast(kind), F.array().cast(kind)), _named) for c in (chosen, rejected))
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    named = pairs.select(*others, a.alias("_a"), b.alias("_b"))
    named = named.withColumn("n_prompt_turns", common_turns(F.col("_a"), F.col("_b")))
    begin = F.col("n_prompt_turns") + 1

    def rest(turns: str) -> Column:
        return F.slice(turns, begin, F.greatest(F.size(turns) - F.col("n_prompt_turns"), F.lit(0)))

    parts = named.withColumns({"_p": F.slice("_a", 1, F.col("n_prompt_turns")), "_c": rest("_a"), "_r": rest("_b")})
    made = parts.withColumns({
        "prompt": rendered(F.col("_p")),
        "chosen": rendered(F.col("_c")),
        "rejected": rendered(F.col("_r")),
        "chosen_mask": mask(F.col("_c")),
        "rejected_mask": mask(F.col("_r")),
    })
    return made.drop("_a", "_b", "_p", "_c", "_r")


def whole_conversations(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``conversation`` and its ``turns`` in order; equal numbers are ordered by role and text.

    A conversation is one row, as it is one example; turns without an id are none's.
    """
    require(turns, conversation, "turn", "role", "text")
    known = turns.filter(F.col(conversation).isNotNull())
    grouped = known.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def swapped_replies(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Each conversation up to its last reply as ``chosen``, and with its neighbour's last reply as ``rejected``.

    Neighbours differ in the last bit of their id. Without a neighbour that replies, the
    rejected version ends before the reply. Without a reply of its own, a conversation is
    both versions as it is.
    """
    places = F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == ASSISTANT, i + 1).otherwise(0))
    own = conversations.withColumn("_last", F.coalesce(F.array_max(places), F.lit(0)))
    reply = F.get(F.col("turns"), F.col("_last") - 1)
    others = own.filter("_last > 0").select(F.col(conversation).bitwiseXOR(F.lit(1)).alias("_of"), reply.alias("_reply"))
    joined = own.join(others, own[conversation] == others["_of"], "left")
    upto = F.when(F.col("_last") > 0, F.slice("turns", 1, F.greatest(F.col("_last"), F.lit(1)))).otherwise(F.col("turns"))
    before = F.when(F.col("_last") > 0, F.slice("turns", 1, F.greatest(F.col("_last") - 1, F.lit(0)))).otherwise(F.col("turns"))
    answer = F.when((F.col("_last") > 0) & F.col("_of").isNotNull(), F.array("_reply"))
    rejected = F.concat(before, F.coalesce(answer, F.array().cast(f"array<{_TURN}>")))
    return joined.select(conversation, upto.alias("chosen"), rejected.alias("rejected"))


def spans_text(spans: str) -> Column:
    """A mask as text: ``start-stop`` for each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
