"""Documents in flat token files, found by their separators alone.

A token file is nothing but ids of fixed width, each document followed by the end id.
Files are cut into blocks of fixed size, whatever they hold; every block is read by
range and searched as one array. A block does not know how many documents began
before it or where the one it starts in began, so a small table of block totals is
scanned in file order and joined back. No file needs an index or a task of its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.llm.columns import require
from velospan.staging import fresh_path, staged

BYTE_BPE = "byte_bpe_50k.tiktoken"
#: The end-of-document id of that vocabulary, free of any text's ids.
END_ID = 50256
BLOCK_TOKENS = 4_000_000
TYPES = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


@cache
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: what the tokenizer's pattern takes for white space.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space in a row from which on it is encoded apart: the pattern looks ahead once for each of it.
LONG_SPACE = 5000


@cache
def _long_space(least: int) -> re.Pattern:
    return re.compile(f"{_SPACE}{{{least},}}")


def token_ids(encoding, text: str) -> list[int]:
    """The ids of a whole text, however much white space stands in a row.

    The pattern takes such a run as one part, without its last character where something
    follows, which goes with that; so the run can be encoded apart from the rest.
    """
    ids: list[int] = []
    at = 0
    for run in _long_space(LONG_SPACE).finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def _system(uri: str):
    """The file system of a path and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", width: int = 2, tokenizer: str = BYTE_BPE
) -> DataFrame:
    """Write one flat file per partition; returns ``file``, ``ordinal`` and ``doc_id`` of what was written.

    A file is written under a name of its own and then moved to its final one, so an
    attempt that is lost leaves nothing behind under that name and a repeated one
    writes the same bytes. A null text is a document without tokens. The table is
    written out at once: reading it again does not write files again.
    """
    require(docs, doc_id, text)
    kind, most = TYPES[width], np.iinfo(TYPES[width]).max
    if END_ID > most:
        raise ValueError(f"the end id does not fit {width} bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding = _encoding(tokenizer)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        hidden, out, ordinal = f"{root}/.{name}.{uuid4().hex}", None, 0
        for batch in batches:
            if batch.num_rows and out is None:
                out = system.open_output_stream(hidden)
            for value in batch.column("text").to_pylist():
                out.write(np.array([*token_ids(encoding, value or ""), END_ID], kind).tobytes())
            n = batch.num_rows
            files = pa.array([name] * n, pa.string())
            ordinals = pa.array(np.arange(ordinal, ordinal + n), pa.int64())
            yield pa.RecordBatch.from_arrays([files, ordinals, batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
            ordinal += n
        if out is not None:
            out.close()
            system.move(hidden, f"{root}/{name}")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(write, f"file string, ordinal bigint, doc_id {kind_of_id}"), "token-file-rows")


def token_blocks(spark: SparkSession, folder: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``path``, ``block`` and ``tokens`` (of the file) for every block of every ``.bin`` file of a folder.

    Only names and lengths are read. A file whose length is no multiple of the width is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    whole = F.when(F.col("length") % width == 0, F.col("length") / width)
    broken = F.raise_error(F.concat(F.lit("not a whole number of tokens: "), "path"))
    tokens = F.coalesce(whole, broken).cast("long")
    counted = files.filter("length > 0").select("path", tokens.alias("tokens"))
    last = F.floor((F.col("tokens") - 1) / block_tokens)
    return counted.select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks with ``ends``: the places in the file, in tokens, of the end ids that each holds."""
    kind = TYPES[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                system, inside = _system(path)
                with system.open_input_file(inside) as source:
                    source.seek(block * block_tokens * width)
                    ids = np.frombuffer(source.read(block_tokens * width), kind)
                found.append(np.flatnonzero(ids == end_id) + block * block_tokens)
            ends = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ends], names=[*batch.schema.names, "ends"])

    return blocks.repartition("path", "block").mapInArrow(search, "path string, tokens bigint, block bigint, ends array<bigint>")


def documents_of(blocks: DataFrame) -> DataFrame:
    """``path``, ``ordinal``, ``start``, ``n_tokens`` and ``ended`` of every document, from scanned blocks.

    Totals of earlier blocks say how many documents ended before a block and where the
    last of them did. Two end ids in a row hold an empty document between them. Ids
    behind a file's last end id are a document that is not ended.
    """
    totals = blocks.select(
        "path", "block", F.size("ends").alias("n"), F.try_element_at(F.col("ends"), F.lit(-1)).alias("last")
    )
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        F.col("path").alias("_path"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("begun"),
    )
    known = blocks.join(carried, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    each = known.select("path", "earlier", "begun", "ends", F.posexplode("ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("begun")).otherwise(F.get(F.col("ends"), F.col("i") - 1) + 1)
    ended = each.select("path", (F.col("earlier") + F.col("i")).alias("ordinal"), start.alias("start"), "stop", F.lit(True).alias("ended"))
    rest = blocks.groupBy("path").agg(
        F.sum(F.size("ends")).alias("ordinal"),
        F.coalesce(F.max(F.try_element_at(F.col("ends"), F.lit(-1))) + 1, F.lit(0)).alias("start"),
        F.max("tokens").alias("stop"),
    )
    rest = rest.filter("start < stop").select("path", "ordinal", "start", "stop", F.lit(False).alias("ended"))
    every = ended.union(rest)
    return every.select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every document of the token files in a folder; files without tokens have none."""
    found = scan_blocks(token_blocks(spark, folder, width, block_tokens), end_id, width, block_tokens)
    return documents_of(staged(found, "token-block-ends"))


def document_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of documents by way of flat files: ``doc_id``, ``file``, ``ordinal``, ``start``, ``n_tokens``."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    written = write_token_files(docs, folder, doc_id, text)
    if written.isEmpty():
        return written.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    found = count_tokens(spark, folder, block_tokens=block_tokens)
    found = found.withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")
    return written.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
