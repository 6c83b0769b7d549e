"""Alignment of two tokenizers over the same bytes by diagonal run skipping.

A text's tokens of either tokenizer are given by where they end, in bytes. Places where
both end cut the tokens into groups. Two sorted arrays of ends are walked along one index
shift: while equal ends go on, the stretch that is compared doubles, so one-to-one
stretches are jumped over; where ends differ the group is resolved by the next common end
and the shift becomes what it is there.

Texts are cut at blanks where neither tokenizer can join anything, and each distinct part
is encoded once. Linked id pairs are counted corpus-wide by documents: a block of texts
lists its distinct pairs once, so a pair that stands in every text meets the others once
a block; counts come back to the block's texts by a cogroup of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from velospan.llm.columns import require
from velospan.llm.memory import give_back
from velospan.llm.token_ids import _byte_names, tokenizer_path
from velospan.staging import staged

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, distinct parts that a worker remembers, and parts encoded at a time.
BLOCK_BYTES, KEPT_PARTS, ENCODED_AT_ONCE = 1_500_000, 250_000, 8192
#: Groups of more links than this are counted by distinct ids before they are multiplied.
LARGE_GROUP = 64
# A blank before white space belongs to what is before it. Format characters that some rules take for
# white space are not trusted either.
_LOOSE = "\u180e\u200b\u2060\ufeff"
_CUT = re.compile(rf"(?<=[^ ]) (?=[^\s{_LOOSE}])")
_NOT_PLAIN = re.compile(rf"  | $| [\s{_LOOSE}]|^[\s{_LOOSE}]")
_ANY_BLANK = re.compile(rf"[\s{_LOOSE}]")
# Fixed value: what stands for a blank in the pieces of the second tokenizer.
_PIECE_BLANK = "\u2581"


# -- two sorted arrays of ends -----------------------------------------------------


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side end at or before every common end, from first to last.

    ``a`` and ``b`` are rising and have the same last value.
    """
    # Common ends in a row at one shift: number of the first and behind the last, and the shift.
    first, behind, shifts = [], [], []
    i, n, shift, begin = 0, len(a), 0, 1
    while i < n:
        step = 1
        # As far as ends stay equal at this shift, twice as many are compared each time ...
        while a[i : i + step] == b[i + shift : i + shift + step]:
            i += step
            if i >= n:
                i = n
                break
            step *= 2
        else:
            # ... and half as many where they do not, down to the first that differs.
            while step > 1:
                step //= 2
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
        first.append(begin)
        behind.append(i + 1)
        shifts.append(shift)
        if i >= n:
            break
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        shift, begin = j + 1 - i, i
    else:
        if n:
            first.append(begin)
            behind.append(n + 1)
            shifts.append(shift)
    begins, counts = np.array(first, np.int64), np.array(behind, np.int64) - np.array(first, np.int64)
    place = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    return place, place + np.repeat(np.array(shifts, np.int64), counts)


# -- tokens ------------------------------------------------------------------------


class _Store:
    """Ids of distinct parts in a row, and where each part's begin."""

    def __init__(self) -> None:
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts at ``places`` in a row, and how many come before each part."""
        first, lengths = self.starts[places], self.starts[places + 1] - self.starts[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)], ends


class TokenPair:
    """Both tokenizers, the bytes of their tokens, and the parts encoded so far.

    ``first`` is a byte-level BPE file that gets a blank before the text, ``second`` a
    model of pieces that adds one itself.
    """

    def __init__(self, first: str, second: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        with open(first, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        names = _byte_names()
        ranks = {bytes(names[c] for c in token): number for token, number in vocabulary.items() if all(c in names for c in token)}
        special = {token for token, number in vocabulary.items() if number in self.first.get_added_tokens_decoder()}
        for token in special:
            ranks.pop(token.encode(), None)
        # The vocabulary's order is that of its merges, so the same file serves where whole lots are encoded.
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = self.first.get_vocab_size(with_added_tokens=True)
        self.first_length, self.first_blank = np.zeros(size, np.int64), np.zeros(size, bool)
        for token, number in ranks.items():
            self.first_length[number], self.first_blank[number] = len(token), token[:1] == b" "
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.second_length = np.array([len(x) for x in self.second_bytes], np.int64)
        self.second_blank = np.array([x[:1] == b" " for x in self.second_bytes])
        self.forget()

    def _piece(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.second.is_byte(number) else piece.replace(_PIECE_BLANK, " ").encode()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.faithful = np.empty(0, bool)
        self.a, self.b = _Store(), _Store()

    def _learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), ENCODED_AT_ONCE):
            some = parts[at : at + ENCODED_AT_ONCE]
            odd = [x for x in some if _ANY_BLANK.search(x)]
            plain = [x for x in some if not _ANY_BLANK.search(x)] if odd else some
            if plain:
                self._learn_plain(plain)
            if odd:
                encoded = self.first.encode_batch_fast([f" {x}" for x in odd], add_special_tokens=False)
                pieces = self.second.encode(odd, num_threads=1)
                for store, lists in ((self.a, [e.ids for e in encoded]), (self.b, pieces)):
                    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                    store.add(np.array([x for ids in lists for x in ids], np.int32), lengths)
                self._remember(odd, [self._spelt(ids) == f" {x}".encode() for x, ids in zip(odd, pieces, strict=True)])

    def _learn_plain(self, parts: list[str]) -> None:
        """Parts without blanks are encoded in one call: each begins with the only blank before it."""
        joined = " ".join(parts)
        a, b = self.ranks.encode_ordinary(f" {joined}"), self.second.encode(joined)
        same = self._spelt(b) == f" {joined}".encode()
        begins = [np.flatnonzero(blank[ids]) for blank, ids in ((self.first_blank, a), (self.second_blank, b))]
        for store, ids, begin in zip((self.a, self.b), (a, b), begins, strict=True):
            store.add(np.array(ids, np.int32), np.diff(np.r_[begin, len(ids)]))
        if same:
            self._remember(parts, [True] * len(parts))
        else:
            cuts = zip(begins[1], [*begins[1][1:], len(b)], strict=True)
            self._remember(parts, [self._spelt(b[low:high]) == f" {x}".encode() for x, (low, high) in zip(parts, cuts, strict=True)])

    def _spelt(self, pieces: list[int]) -> bytes:
        return b"".join(map(self.second_bytes.__getitem__, pieces))

    def _remember(self, parts: list[str], faithful: list[bool]) -> None:
        self.faithful = np.concatenate([self.faithful, np.array(faithful, bool)])
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts)), strict=True))

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides in a row, and where each text's begin (one more than texts).

        Texts that are null or empty, or of which a token's bytes differ, have none.
        """
        parts: list[str] = []
        bounds = [0]
        for text in texts:
            if text and _PIECE_BLANK not in text:
                parts += _CUT.split(text) if _NOT_PLAIN.search(text) else text.split(" ")
            bounds.append(len(parts))
        if len(self.place) > KEPT_PARTS:
            self.forget()
        self._learn([x for x in dict.fromkeys(parts) if x not in self.place])
        places = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        at = np.array(bounds)
        wrong = np.concatenate([[0], np.cumsum(~self.faithful[places])])[at]
        text_of = np.repeat(np.arange(len(texts)), np.diff(at))
        good = (np.diff(wrong) == 0)[text_of]
        places, text_of = places[good], text_of[good]
        at = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(texts)))])
        (a, a_ends), (b, b_ends) = self.a.gather(places), self.b.gather(places)
        return a, a_ends[at], b, b_ends[at]


# -- groups, links, and their counts in a block ------------------------------------


class _Groups:
    """The groups of a block's texts: where each begins on either side, and its text."""

    def __init__(self, pair: TokenPair, texts: list[str | None]) -> None:
        self.a, self.a_at, self.b, self.b_at = pair.tokens(texts)
        # Texts end with a common end, so that one walk over all of them crosses none.
        ends = [np.cumsum(pair.first_length[self.a]).tolist(), np.cumsum(pair.second_length[self.b]).tolist()]
        upto_a, upto_b = common_ends(*ends)
        self.a_begin, self.b_begin = (np.concatenate([[0], x]) for x in (upto_a, upto_b))
        self.first = np.searchsorted(self.a_begin, self.a_at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.n_a, self.n_b = np.diff(self.a_begin), np.diff(self.b_begin)

    def links(self, n_second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text as (text, a * n_second + b, times), sorted."""
        links = self.n_a * self.n_b
        small = np.flatnonzero(links <= LARGE_GROUP)
        group = np.repeat(small, links[small])
        place = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        a = self.a[self.a_begin[group] + place // self.n_b[group]].astype(np.int64)
        b = self.b[self.b_begin[group] + place % self.n_b[group]]
        codes, owners, times = [a * n_second + b], [self.text[group]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > LARGE_GROUP).tolist():
            x, nx = np.unique(self.a[self.a_begin[g] : self.a_begin[g + 1]], return_counts=True)
            y, ny = np.unique(self.b[self.b_begin[g] : self.b_begin[g + 1]], return_counts=True)
            codes.append((x.astype(np.int64)[:, None] * n_second + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            owners.append(np.full(len(codes[-1]), self.text[g]))
        code, owner, weight = np.concatenate(codes), np.concatenate(owners), np.concatenate(times)
        by = np.lexsort((code, owner))
        code, owner, weight = code[by], owner[by], weight[by]
        new = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])][: len(code)]
        at = np.flatnonzero(new)
        return owner[at], code[at], np.add.reduceat(weight, at) if len(at) else weight

    def lines(self, names: tuple[list[str], ...]) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2``: ids in order, and nothing without tokens."""
        a_group = np.repeat(np.arange(len(self.n_a)), self.n_a)
        b_group = np.repeat(np.arange(len(self.n_b)), self.n_b)
        name = np.empty(len(self.a) + len(self.b), np.int32)
        size_a, size_b = len(names[0]), len(names[2])
        a_last = np.arange(1, len(self.a) + 1) == self.a_begin[a_group + 1]
        b_last = np.arange(1, len(self.b) + 1) == self.b_begin[b_group + 1]
        name[np.arange(len(self.a)) + self.b_begin[a_group]] = self.a + size_a * a_last
        name[np.arange(len(self.b)) + self.a_begin[b_group + 1]] = self.b + 2 * size_a + size_b * b_last
        table = [x for some in names for x in some]
        spelt = list(map(table.__getitem__, name.tolist()))
        at = (self.a_at + self.b_at).tolist()
        return ["".join(spelt[low:high])[:-1] for low, high in zip(at[:-1], at[1:], strict=True)]


_BLOCKS = (
    "block bigint, doc_id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    "pairs array<int>, times array<bigint>, codes array<bigint>, holders array<int>"
)
_ARROW_BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.string()),
    *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()),
    ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
    ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())),
])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // BLOCK_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]]).tolist()
    return ((low, high) for low, high in zip(cuts[:-1], cuts[1:], strict=True) if high > low)


def _block_rows(pair: TokenPair, names: tuple, number: int, ids: pa.Array, texts: list[str | None], digests: bool) -> Iterator[pa.RecordBatch]:
    """A row per text, and one that lists the block's distinct pairs and how many texts hold each."""
    groups = _Groups(pair, texts)
    owner, code, times = groups.links(len(pair.second_length))
    codes, pairs, holders = np.unique(code, return_inverse=True, return_counts=True)
    n, bounds = len(texts), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    links = np.bincount(owner, times, n).astype(np.int64)
    lines = groups.lines(names)
    if digests:
        lines = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]
    listed = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t)) for x, t in ((pairs, pa.int32()), (times, pa.int64()))]
    counts = [np.diff(groups.a_at), np.diff(groups.b_at), np.diff(groups.first), links]
    none = [pa.nulls(n, f.type) for f in _ARROW_BLOCKS][-2:]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, number)), ids, *map(pa.array, counts), pa.array(lines, pa.string()), *listed, *none],
        schema=_ARROW_BLOCKS,
    )
    if len(codes):
        row = {"block": [number], "codes": [codes], "holders": [holders.astype(np.int32)]}
        yield pa.RecordBatch.from_arrays([pa.array(row.get(f.name, [None]), f.type) for f in _ARROW_BLOCKS], schema=_ARROW_BLOCKS)


def _aligned(batches: Iterator[pa.RecordBatch], first: str, second: str, digests: bool) -> Iterator[pa.RecordBatch]:
    pair = TokenPair(first, second)
    a, b = ([str(i) for i in range(len(x))] for x in (pair.first_length, pair.second_length))
    names = ([f"{x}," for x in a], [f"{x}|" for x in a], [f"{x}," for x in b], [f"{x};" for x in b])
    # Blocks are numbered within the partition; the table is written before anything is joined on them.
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for low, high in _slices(batch["text"]):
            part = batch.slice(low, high - low)
            yield from _block_rows(pair, names, number, part["doc_id"], part["text"].to_pylist(), digests)
            give_back()
            number += 1


def _counted(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's texts with what their links count corpus-wide."""
    place = pairs["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    listed = texts["pairs"].combine_chunks()
    bounds = listed.offsets.to_numpy() - listed.offsets[0].as_py()
    own = listed.flatten().to_numpy()
    times = texts["times"].combine_chunks().flatten().to_numpy()
    sums = []
    for values in (best[own] * times, count[own] * times):
        upto = np.concatenate([[0], np.cumsum(values)])
        sums.append(pa.array(upto[bounds[1:]] - upto[bounds[:-1]]))
    kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1])


def align(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    first: str | None = None,
    second: str | None = None,
    digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``first`` and ``second`` are the paths of the tokenizers' files. Tokens of the first
    are those of a blank and the text. ``groups`` spells every group's ids
    (``a1,a2|b1;a3|b2``), or is its sha256 with ``digests``. A link is a pair of tokens of
    one group, its count the number of rows of ``docs`` that hold its two ids linked;
    ``n_best`` links have the highest count of their first id, and ``count_sum`` adds all.

    Null and empty texts, and those that a tokenizer does not give back byte for byte,
    have no tokens: zeros and an empty ``groups``. Repeated rows count each; other columns
    do not matter; an empty table gives an empty one.
    """
    require(docs, doc_id, text)
    kind = docs.schema[doc_id].dataType
    plain = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    paths = first or tokenizer_path(BYTE_BPE), second or tokenizer_path(PIECE_BPE)
    run = partial(_aligned, first=paths[0], second=paths[1], digests=digests)
    table = staged(plain.mapInArrow(run, _BLOCKS), "alignment")

    zipped = F.posexplode(F.arrays_zip("codes", "holders")).alias("place", "x")
    listed = table.filter("codes IS NOT NULL").select("block", zipped)
    listed = listed.select("block", "place", F.col("x.codes").alias("code"), F.col("x.holders").alias("holders"))
    counted = listed.groupBy("code").agg(F.sum("holders").alias("count"))
    # An id has at most as many partners as the other vocabulary has entries.
    n_second = F.lit(vocabulary_size(paths[1]))
    partners = W.partitionBy(F.floor(F.col("code") / n_second))
    counted = staged(counted.withColumn("best", (F.col("count") == F.max("count").over(partners)).cast("int")), "pair-counts")
    back = listed.join(counted, "code").select(F.col("block").alias("of_block"), "place", "count", "best")
    texts = table.filter("codes IS NULL").drop("codes", "holders")
    schema = "doc_id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint"
    done = texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_counted, schema)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return done.select(F.col("doc_id").cast(kind).alias("doc_id"), *order)


def vocabulary_size(second: str) -> int:
    """Number of pieces of a model file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
