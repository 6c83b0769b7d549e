"""Removal of long byte strings that repeat anywhere in a corpus, by suffix arrays of shards.

Every string of ``length`` bytes has an anchor: of the short strings inside it, the one
with the least hash (the last of them). It is settled by the string's own bytes, so equal
strings have equal anchors at equal places, and the strings of a text fall into segments
that share an anchor. Segments of equal bytes are counted as one; where an anchor has
segments of different bytes, one of each goes to a shard. A shard's suffixes are sorted by
induction, and common prefixes in text order tell which of its strings stand twice.

Anchors of more segments than a shard should hold are divided: segments are cut shorter and
dealt by the bytes that all strings of a piece share, again and again down to single
strings, which need no shard. Nothing is dropped on the way: a piece leaves only when all
its strings are known to repeat, or to share their bytes with no other piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.llm.columns import require, unused, whole_text
from velospan.llm.induced_sort import permuted_common_prefix, suffix_array
from velospan.staging import staged

#: Bytes of a repeated string, and of the strings inside it whose hashes are compared.
LENGTH, GRAM = 400, 48
#: Bytes of a shard, pieces that share bytes in one shard, and strings of a piece where there are more.
SHARD_BYTES, CROWD, CUTS = 1 << 20, 1024, (64, 16, 4, 1)
#: Strings that are told at once to share their bytes with no other piece of a shard.
ALONE = 32
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 21
_PLACE_BITS = 23
# Seeds and odd factors of the hash; any others do.
_TABLE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_END, _GAP, _FIRST = 0, 1, 2


# -- anchors -----------------------------------------------------------------------


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, as many as a chunk has bytes."""
    inverse = pow(_BASE, -1, 1 << 64)
    made = []
    for base in (_BASE, inverse):
        steps = np.full(CHUNK + LENGTH, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return made[0], made[1]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the bytes of every string of ``gram`` bytes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _least_places(hashes: np.ndarray, wide: int) -> np.ndarray:
    """The place of the least hash among ``wide`` in a row, for every first one; the last of equal ones."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    reach = 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: reach - wide], least[wide - reach :])
    return (low - (least & low)).astype(np.int64)


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First string, number of strings, place of the anchor behind the first, and its hash, of each segment in order.

    Long texts are hashed in chunks that overlap. A chunk's edge may divide a segment;
    its strings keep their anchor.
    """
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)] + [[np.empty(0, np.uint64)]]
    whole, step = np.frombuffer(data, np.uint8), CHUNK - length
    for base in range(0, max(len(data) - length + 1, 0), step):
        hashes = _gram_hashes(whole[base : base + step + length - 1], gram)
        at = _least_places(hashes, length - gram + 1)
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        own = begins + base, np.diff(np.r_[begins, len(at)]), at[begins] - begins, hashes[at[begins]]
        for some, values in zip(found, own, strict=True):
            some.append(values)
    return tuple(np.concatenate(x) for x in found)


def _digests(parts: Iterable[bytes]) -> np.ndarray:
    """128 bits of each part's bytes as two whole numbers."""
    joined = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts)
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _schema(columns: str, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([*((c, pa.int64()) for c in columns.split()), *more])


# Texts and segments go by 128 bits of their bytes: t1 and t2, s1 and s2.
_ROWS = _schema("t1 t2 first strings times at key s1 s2")
_PIECES = _schema("t1 t2 first strings n at key s1 s2 kinds", ("bytes", pa.binary()))
_CUTS = _schema("t1 t2 first strings n at key s1 s2", ("bytes", pa.binary()))
_SPANS = _schema("t1 t2 start upto")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The segments of every text; equal ones in a row, as in periodic texts, are one row."""
    for batch in batches:
        for t1, t2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) < length:
                continue
            first, count, at, anchor = segments(text, length)
            digest = _digests(text[a : a + n + length - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True))
            same = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1]).all(axis=1)
            head = np.flatnonzero(np.r_[True, ~same])
            n, times = len(head), np.diff(np.r_[head, len(first)])
            own = [np.full(n, t1), np.full(n, t2), first[head], count[head], times, at[head], anchor[head].view(np.int64)]
            yield _batch(_ROWS, [*own, *np.ascontiguousarray(digest[head].T)])


# -- pieces with their bytes -------------------------------------------------------


def _taken(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row with its bytes for every wanted segment of a text."""
    for batch in batches:
        for row in batch.to_pylist():
            text, wanted = row["text"], row["wanted"]
            columns = [[x[c] for x in wanted] for c in _PIECES.names[2:-1]]
            parts = [text[x["first"] : x["first"] + x["strings"] + length - 1] for x in wanted]
            yield _batch(_PIECES, [[row["t1"]] * len(wanted), [row["t2"]] * len(wanted), *columns, parts])


def _edges(strings: int, at: int, range_: int) -> list[int]:
    """Where the strings of a segment change from one range of distances to their anchor to the next, with both ends.

    String i is ``at`` - i from the anchor; equal strings have equal distances.
    """
    return sorted({0, strings, *range(at % range_ + 1, strings, range_)})


def _core(data: bytes, at: int, low: int, range_: int, length: int) -> tuple[int, bytes]:
    """The range of distances that string ``low`` is in, and the bytes that all strings of the range share."""
    far = (at - low) // range_
    return far, data[at - far * range_ : at - (far + 1) * range_ + 1 + length]


def _cut(batches: Iterator[pa.RecordBatch], length: int, strings: int) -> Iterator[pa.RecordBatch]:
    """Shorter pieces, keyed by the bytes that all strings of one share.

    Strings are told apart by how far their anchor is from their start, which is the same
    for equal strings: a piece has those of one range of ``strings`` distances.
    """
    for batch in batches:
        for row in batch.to_pylist():
            data, n, at = row["bytes"], row["strings"], row["at"]
            cuts = _edges(n, at, strings)
            columns: list[list] = [[] for _ in _CUTS]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                far, core = _core(data, at, low, strings, length)
                piece = data[low : high + length - 1]
                (key, _), (s1, s2) = _digests((b"%d " % far + core, b"%d " % (at - low) + piece)).tolist()
                values = (row["t1"], row["t2"], row["first"] + low, high - low, row["n"], at - low, key, s1, s2, piece)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield _batch(_CUTS, columns)


# -- shards ------------------------------------------------------------------------


def _not_alone(table: pa.Table, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """What of a shard's pieces may stand twice: bytes, piece, first string and number of strings.

    Strings of one range of distances go only where another piece has the bytes that the
    range shares, and one of the two is single.
    """
    columns = [table[c].to_pylist() for c in ("bytes", "strings", "at", "n")]
    edges = [_edges(strings, at, ALONE) for strings, at in zip(columns[1], columns[2], strict=True)]
    cores = [[_core(data, at, low, ALONE, length) for low in e[:-1]] for data, at, e in zip(columns[0], columns[2], edges, strict=True)]
    times: dict[tuple[int, bytes], int] = {}
    single: set[tuple[int, bytes]] = set()
    for own, n in zip(cores, columns[3], strict=True):
        for core in own:
            times[core] = times.get(core, 0) + 1
        if n == 1:
            single.update(own)
    parts, piece, first, strings = [], [], [], []
    for number, (data, e, own) in enumerate(zip(columns[0], edges, cores, strict=True)):
        wanted = [times[core] > 1 and core in single for core in own]
        # Neighbouring ranges that both go are one part.
        begins = [low for low, here, left in zip(e, wanted, [False, *wanted]) if here and not left]
        ends = [high for high, here, right in zip(e[1:], wanted, [*wanted[1:], False]) if here and not right]
        for low, high in zip(begins, ends, strict=True):
            parts.append(data[low : high + length - 1])
            piece.append(number)
            first.append(low)
            strings.append(high - low)
    return parts, np.array(piece, np.int64), np.array(first, np.int64), np.array(strings, np.int64)


def _shard_spans(table: pa.Table, length: int) -> pa.Table:
    """The stretches of a shard's single pieces whose strings stand twice in the shard."""
    parts, piece, inside, strings = _not_alone(table, length)
    sizes = np.array([len(x) + 1 for x in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    s = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8).astype(np.int64) + _FIRST
    s[begins + sizes - 1], s[-1] = _GAP, _END
    order = suffix_array(s)
    prefix = permuted_common_prefix(s, order, np.append(begins, len(s) - 1))
    before = np.empty(len(s), np.int64)
    before[order[1:]], before[order[0]] = order[:-1], 0
    owner = np.repeat(np.arange(len(parts)), strings)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings) + begins[owner]
    again = place[prefix[place] >= length]
    twice = np.zeros(len(s), bool)
    twice[again] = twice[before[again]] = True
    mine = twice[place] & (table["n"].to_numpy() == 1)[piece][owner]
    owner, place = owner[mine], place[mine]
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])][: len(place)])
    last = np.r_[head[1:], len(place)][: len(head)] - 1
    own = piece[owner[head]]
    shift = table["first"].to_numpy()[own] + inside[owner[head]] - begins[owner[head]]
    columns = [table["t1"].to_numpy()[own], table["t2"].to_numpy()[own], place[head] + shift, place[last] + shift + length]
    return pa.Table.from_batches([_batch(_SPANS, columns)])


def _crowded(kinds: DataFrame) -> DataFrame:
    """``kinds`` of whose key there are others, with their number."""
    others = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return kinds.join(others, "key")


def _among_pieces(pieces: DataFrame, length: int) -> Iterator[DataFrame]:
    """Spans of the pieces of ``n`` 1 whose strings stand in another piece of their key too."""
    for strings in (*CUTS, None):
        cold = pieces.filter(F.col("kinds") <= CROWD)
        size = cold.agg(F.sum(F.length("bytes"))).first()[0] or 0
        if size:
            shard = F.pmod(F.xxhash64("key"), F.lit(1 + size // SHARD_BYTES)).alias("shard")
            dealt = cold.select("t1", "t2", "first", "strings", "n", "at", "bytes", shard)
            yield dealt.groupBy("shard").applyInArrow(lambda t: _shard_spans(t, length), _ddl(_SPANS))
        hot = pieces.filter(F.col("kinds") > CROWD)
        if strings is None or hot.isEmpty():
            return
        cut = staged(hot.drop("kinds").mapInArrow(partial(_cut, length=length, strings=strings), _ddl(_CUTS)), "cut-pieces")
        first = [F.first(c).alias(c) for c in ("t1", "t2", "first", "strings", "at")]
        kinds = cut.groupBy("key", "s1", "s2").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"), *first)
        kinds = staged(kinds, "cut-kinds")
        twice = kinds.filter("n > 1").select("key", "s1", "s2")
        yield _spans(cut.filter("n = 1").join(twice, ["key", "s1", "s2"]), F.col("strings"), length)
        pieces = staged(_crowded(kinds).select(*_PIECES.names), "cut-crowded")


def _spans(rows: DataFrame, strings: Column, length: int) -> DataFrame:
    return rows.select("t1", "t2", F.col("first").alias("start"), (F.col("first") + strings + length - 1).alias("upto"))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``t1``, ``t2``, ``start`` and ``upto`` of stretches that cover all repeated strings of ``t1``, ``t2``, ``text`` (bytes)."""
    found = texts.mapInArrow(partial(_segment_rows, length=length), _ddl(_ROWS))
    rows = staged(found, "segments")
    first = [F.first(c).alias(c) for c in ("t1", "t2", "first", "strings", "at")]
    kinds = staged(rows.groupBy("key", "s1", "s2").agg(F.sum("times").alias("n"), *first), "segment-kinds")
    twice = kinds.filter("n > 1").select("key", "s1", "s2")
    spans = _spans(rows.join(twice, ["key", "s1", "s2"]), F.col("strings") * F.col("times"), length)

    # Of equal texts one is enough, and texts meet their wanted segments where they were made one.
    wanted = F.collect_list(F.struct(*_PIECES.names[2:-1])).alias("wanted")
    wanted = _crowded(kinds).groupBy("t1", "t2").agg(wanted)
    single = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    taken = single.join(wanted, ["t1", "t2"]).mapInArrow(partial(_taken, length=length), _ddl(_PIECES))
    for more in _among_pieces(staged(taken, "segment-pieces"), length):
        spans = spans.union(more)
    return spans


# -- the operator ------------------------------------------------------------------

_KEPT = "n_bytes bigint, spans array<struct<start: bigint, upto: bigint>>, kept binary"
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("upto", pa.int64())])
_ARROW_KEPT = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(_ARROW_SPAN)), ("kept", pa.binary())])


def _kept(text: bytes, spans: list | None) -> dict:
    """The maximal stretches that spans cover, and the bytes outside them."""
    merged: list[list[int]] = []
    for start, upto in sorted((x["start"], x["upto"]) for x in spans or []):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], upto)
        else:
            merged.append([start, upto])
    edges = [0, *(x for span in merged for x in span), len(text)]
    kept = b"".join(text[low:high] for low, high in zip(edges[::2], edges[1::2], strict=True))
    return {"n_bytes": len(text), "spans": [{"start": a, "upto": b} for a, b in merged], "kept": kept}


def without_repeats(docs: DataFrame, text: str = "text", name: str = "repeats", length: int = LENGTH) -> DataFrame:
    """``docs`` with a column ``name`` (replaced if there): ``n_bytes``, ``spans`` (start, upto) and ``kept`` bytes.

    A text is its UTF-8 bytes. ``spans`` are the maximal stretches covered by strings of
    ``length`` bytes that start at another place of the corpus too, in the same row or any
    other; strings are judged on the input and end with their text. ``kept`` is what is
    left. Null texts are empty; texts shorter than ``length`` stay whole; equal rows repeat
    one another. An empty table gives an empty one.
    """
    require(docs, text)
    if length <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    docs = docs.drop(name)
    t1, t2, whole, wide = (unused(docs, c) for c in ("t1", "t2", "whole", "wide"))
    digest = F.md5(F.col(whole))
    halves = [F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint") for at in (1, 17)]
    keyed = docs.withColumn(whole, whole_text(text).cast("binary")).withColumns({t1: halves[0], t2: halves[1]})
    texts = keyed.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), F.col(whole).alias("text"))
    spans = repeated_spans(texts.filter(F.length("text") >= length), length).distinct()
    spans = spans.groupBy(F.col("t1").alias("of1"), F.col("t2").alias("of2")).agg(
        F.collect_list(F.struct("start", "upto")).alias(wide)
    )

    @F.arrow_udf(T._parse_datatype_string(_KEPT))
    def kept(data: pa.Array, covered: pa.Array) -> pa.Array:
        return pa.array([_kept(x, y) for x, y in zip(data.to_pylist(), covered.to_pylist(), strict=True)], _ARROW_KEPT)

    joined = keyed.join(spans, (F.col(t1) == F.col("of1")) & (F.col(t2) == F.col("of2")), "left")
    return joined.withColumn(name, kept(F.col(whole), F.col(wide))).select(*docs.columns, name)
