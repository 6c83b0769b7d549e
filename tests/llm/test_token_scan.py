from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from velospan.llm import token_scan
from velospan.staging import fresh_path


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_documents_across_blocks(spark, tmp_path, block):
    rng, want = random.Random(block), []
    files = {"a": [9, 9, 1, 2, 9, 3], "b": [1] * 25 + [9], "c": [], "d": [5, 6], "e": [9]}
    files |= {f"r{i}": [rng.choice([1, 2, 3, 9]) for _ in range(rng.randint(1, 60))] for i in range(6)}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / f"{name}.bin")
        start, ordinal = 0, 0
        for at, x in enumerate(ids):
            if x == 9:
                want.append((name, ordinal, start, at - start, True))
                start, ordinal = at + 1, ordinal + 1
        if start < len(ids):
            want.append((name, ordinal, start, len(ids) - start, False))
    (tmp_path / "other.txt").write_text("no tokens")
    got = token_scan.count_tokens(spark, f"file://{tmp_path}", 9, 2, block).collect()
    assert sorted((r["path"].split("/")[-1][:-4], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in got) == sorted(want)


def test_a_torn_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        token_scan.count_tokens(spark, str(tmp_path)).collect()


def test_counts_equal_those_of_the_encoder(spark, odd, odd_rows, nothing):
    encode = token_scan._encoding(token_scan.BYTE_BPE).encode_ordinary
    rows = odd_rows + [(50, "<|endoftext|> is ordinary text", "en", "a", 1)]
    got = token_scan.document_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), block_tokens=100).collect()
    want = sorted((r[0] or -1, len(encode(r[1] or ""))) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert token_scan.document_tokens(nothing).count() == 0


def test_files_hold_nothing_but_ids(spark, odd):
    folder = fresh_path(spark, "flat")
    rows = token_scan.write_token_files(odd.coalesce(1), folder).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(odd.count()))
    ids = np.fromfile(f"{folder.removeprefix('file://')}/{rows[0]['file']}", "<u2")
    assert (ids == token_scan.END_ID).sum() == odd.count() and ids[-1] == token_scan.END_ID


def test_long_white_space_is_encoded_like_any(monkeypatch):
    rng = random.Random(5)
    encoding = token_scan._encoding(token_scan.BYTE_BPE)
    parts = [" ", "  ", "\n", "\t", "　", "\x1c", "word", "é", "12", ".", "'s", " \n "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)] + ["   a", "a   ", " \n", "\n\n\nb"]
    whole = [encoding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(token_scan, "LONG_SPACE", 2)
    assert [token_scan.token_ids(encoding, t) for t in texts] == whole
    monkeypatch.undo()
    for blank in (" ", "\n"):
        ids = token_scan.token_ids(encoding, f"a{blank * 2_000_000}b")
        assert b"".join(map(encoding.decode_single_token_bytes, ids)) == f"a{blank * 2_000_000}b".encode()
