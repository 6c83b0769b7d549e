from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from velospan.llm import pattern_packing, token_ids

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def whole_ids(texts):
    encoder = token_ids.word_encoder(token_ids.tokenizer_path())
    return [e.ids for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_ids_by_words_equal_ids_of_whole_texts():
    rng = random.Random(5)
    alphabet = [*"ab s'tLLré̸́İΣς.,;!$%#|<>'\n\t\r\x1c\x85 　 019½ñ", "<|endoftext|>", "'s", "日本", "😀", "ﬁ", "ŷ,"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + [None, ""]
    ids, starts = token_ids.word_encoder(token_ids.tokenizer_path()).encode(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])] == whole_ids(texts)


def fill(runs, capacity):
    filled = np.zeros(int((runs["sequence_from"] + runs["n"]).max()), int)
    for length, _, n, first, offset in runs.itertuples(index=False):
        assert (filled[first : first + n] == offset).all()
        filled[first : first + n] += length
    assert filled.max() <= capacity and filled.min() > 0
    return filled


@pytest.mark.parametrize("seed,low,high", [(1, 1, 2048), (2, 1, 300), (3, 400, 1400), (4, 1, 20), (5, 1500, 2049)])
def test_plans_place_every_piece_once_in_few_sequences(seed, low, high):
    lengths = np.random.default_rng(seed).integers(low, high, 4000)
    histogram = np.bincount(lengths, minlength=2049)
    runs = pattern_packing.plan_runs(histogram)
    placed = np.zeros(2049, int)
    np.add.at(placed, runs["length"], runs["n"])
    assert (placed == histogram).all()
    for _, same in runs.groupby("length"):
        ordered = same.sort_values("rank_from")
        assert (ordered["rank_from"].to_numpy()[1:] == (ordered["rank_from"] + ordered["n"]).to_numpy()[:-1]).all()
    n = len(fill(runs, 2048))
    assert n >= lengths.sum() / 2048 and n <= best_fit_decreasing(lengths) * 1.01 + 1


def best_fit_decreasing(lengths, capacity=2048):
    free, n = np.zeros(capacity + 1, int), 0
    for length in sorted(lengths.tolist(), reverse=True):
        fits = np.flatnonzero(free[length:])
        if len(fits):
            free[length + fits[0]] -= 1
            free[fits[0]] += 1
        else:
            n += 1
            free[capacity - length] += 1
    return n


def test_least_squares_fits_without_negative_repeats():
    a = np.array([[2.0, 1, 0], [0, 1, 1], [0, 0, 1]])
    assert np.allclose(pattern_packing.fit_counts(a, a @ np.array([3.0, 0, 2])), [3, 0, 2], atol=1e-6)
    assert np.allclose(pattern_packing.fit_counts(np.array([[1.0, 1], [0, 1]]), np.array([1.0, -5])), [1, 0])


def test_pieces_and_places_of_odd_documents(odd, odd_rows, nothing):
    packed = pattern_packing.pack_documents(odd.withColumn("piece", F.lit("x"))).toPandas()
    want = []
    for (doc_id, *_), ids in zip(odd_rows, whole_ids(r[1] for r in odd_rows), strict=True):
        ids = np.array([*ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            want.append((doc_id or -1, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    got = packed[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64")
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    for _, sequence in packed.sort_values("offset").groupby("sequence_id"):
        ends = np.concatenate([[0], np.cumsum(sequence["length"])])
        assert (sequence["offset"].to_numpy() == ends[:-1]).all() and ends[-1] <= 2048
    assert pattern_packing.pack_documents(nothing).count() == 0


def test_sequences_hold_the_ids_of_their_pieces(odd, odd_rows):
    packed = pattern_packing.pack(pattern_packing.staged(pattern_packing.token_pieces(odd, keep_ids=True), "kept"))
    rows = pattern_packing.sequences(packed).collect()
    assert all(len(r["ids"]) <= 2048 for r in rows)
    assert sum(len(r["ids"]) for r in rows) == sum(len(x) + 1 for x in whole_ids(r[1] for r in odd_rows))
