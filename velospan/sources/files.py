"""Files under names of their own, written by executors through the file system of a folder.

Spark's writers choose file names themselves. Here a row, or rows in order, are a file: its content goes to a
hidden name beside the final one and is renamed when it is whole, so a reader never sees
half a file, a lost attempt leaves nothing under a final name, and an attempt that runs
twice ends with the same bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velospan.staging import staged

#: A row of files is a batch of its own for executors, whatever its size.
CONTENT, PATH, GZIP_BYTES = "content", "path", "gzip_bytes"
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a file that are packed, or read in stretches, at a time.
PART_BYTES = 1 << 20
#: Bytes of files that are worth a task, and the most tasks.
TASK_BYTES, MOST_TASKS = 1 << 25, 10_000


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark itself would read it by."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:///", system.makeQualified(folder).toString())


def system_of(uri: str):
    """The file system of a qualified path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Spool:
    """A file on its way: what is added goes to a hidden name beside the final one, with its digest and size."""

    def __init__(self, system, folder: str, name: str) -> None:
        system.create_dir(folder, recursive=True)
        self.system, self.folder = system, folder
        self.hidden = f"{folder}/.{name}.{uuid4().hex}"
        self.out = system.open_output_stream(self.hidden, compression=None)
        self.digest, self.size = hashlib.sha256(), 0

    def add(self, data) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def settle(self, name: str, replace: bool = False) -> int:
        """Give the file its name unless one of its size is there, and a gzip copy; returns the size of the copy."""
        from pyarrow import fs

        self.out.close()
        path = f"{self.folder}/{name}"
        packed = None if replace else self._packed_size(f"{path}.gz")
        if packed is None:
            packed = self._pack(f"{path}.gz", replace)
        there = self.system.get_file_info(path)
        if not replace and there.type == fs.FileType.File and there.size == self.size:
            self.system.delete_file(self.hidden)
        else:
            self._rename(self.hidden, path, replace)
        return packed

    def drop(self) -> None:
        """Leave nothing of a file that did not become whole."""
        self.out.close()
        self.system.delete_file(self.hidden)

    def _packed_size(self, path: str) -> int | None:
        """Bytes of a whole gzip copy that is there: its last four bytes are the size of what it holds."""
        from pyarrow import fs

        there = self.system.get_file_info(path)
        if there.type != fs.FileType.File or there.size < 18:
            return None
        with self.system.open_input_file(path) as source:
            source.seek(there.size - 4)
            return there.size if int.from_bytes(source.read(4), "little") == self.size % (1 << 32) else None

    def _pack(self, path: str, replace: bool) -> int:
        """Gzip bytes that depend on the content alone, a part of the file at a time."""
        packer, hidden, size = zlib.compressobj(9, zlib.DEFLATED, 31), f"{self.hidden}.gz", 0
        with self.system.open_input_file(self.hidden) as source, self.system.open_output_stream(hidden, compression=None) as out:
            while part := source.read(PART_BYTES):
                size += out.write(packer.compress(part))
            size += out.write(packer.flush())
        self._rename(hidden, path, replace)
        return size

    def _rename(self, hidden: str, path: str, replace: bool) -> None:
        from pyarrow import fs

        try:
            self.system.move(hidden, path)
        except OSError:
            # Some systems do not rename onto a file: another attempt wrote it, or it is to be replaced.
            if self.system.get_file_info(path).type != fs.FileType.File:
                raise
            if replace:
                self.system.delete_file(path)
                self.system.move(hidden, path)
            else:
                self.system.delete_file(hidden)


def _spool_of(system, base: str, path: str) -> _Spool:
    folder, _, name = f"{base}/{path}".rpartition("/")
    return _Spool(system, folder, name)


@contextmanager
def _rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(ROWS_A_BATCH)
    spark.conf.set(ROWS_A_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(ROWS_A_BATCH, before)


def write_files(files: DataFrame, root: str, content: str = CONTENT, replace: bool = False) -> DataFrame:
    """Write every row's ``content`` to ``root/path`` and, packed, to ``root/path.gz``.

    Returns the other columns with ``gzip_bytes``, as a table: reading it again writes
    nothing again. Files named by their content are left alone where they are already;
    ``replace`` writes files whose name says nothing of their content.
    """
    spark = files.sparkSession
    folder = qualified(spark, root)
    kept = [c for c in files.columns if c != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*kept).schema.fields)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = system_of(folder)
        for batch in batches:
            sizes = []
            for path, text in zip(batch[PATH].to_pylist(), batch[content], strict=True):
                spool = _spool_of(system, base, path)
                try:
                    spool.add(memoryview(text.as_buffer()))
                    sizes.append(spool.settle(path.rpartition("/")[2], replace))
                    spool = None
                finally:
                    if spool is not None:
                        spool.drop()
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(sizes, pa.int64())], names=[*kept, GZIP_BYTES])

    whole = files.select(*kept, F.col(content).cast("string").alias(content))
    with _rows_a_batch(spark, 1):
        return staged(whole.mapInArrow(write, f"{schema}, {GZIP_BYTES} bigint"), "written-files")


def write_pieces(pieces: DataFrame, root: str, keys: list[str], sums: list[str], digits: int) -> DataFrame:
    """Write files whose content comes in pieces, and gzip copies, named by their content.

    The pieces of a file are neighbours in one partition, in order. Of a piece, ``stem`` is
    the path before the digest, ``text`` its bytes, ``begins`` whether a file begins with it,
    and ``item`` whether it is one of a list: neighbours that are get a comma between them.
    A file is never held, whatever its size. Returns a row per file, as a table: ``keys`` of
    its first piece, ``sums`` over its pieces, ``path``, ``hash``, ``bytes`` and ``gzip_bytes``.
    """
    folder = qualified(pieces.sparkSession, root)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keys).schema.fields)
    schema = f"{typed}, {''.join(f'`{c}` bigint, ' for c in sums)}path string, hash string, bytes bigint, {GZIP_BYTES} bigint"
    names = [*keys, *sums, PATH, "hash", "bytes", GZIP_BYTES]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = system_of(folder)
        spool, stem, first, counts, listed = None, "", [], [], False

        def settled() -> pa.RecordBatch:
            digest = spool.digest.hexdigest()[:digits]
            path = f"{stem}.{digest}.json"
            row = [*counts, path, digest, spool.size, spool.settle(path.rpartition("/")[2])]
            return pa.RecordBatch.from_arrays([*first, *(pa.array([x]) for x in row)], names=names)

        try:
            for batch in batches:
                begins, items, texts = (batch[c].to_pylist() for c in ("begins", "item", "text"))
                starts = sorted({0, *(i for i, b in enumerate(begins) if b)})
                for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                    if begins[low]:
                        if spool is not None:
                            yield settled()
                            spool = None
                        stem, first, counts, listed = batch["stem"][low].as_py(), [batch[c].slice(low, 1) for c in keys], [0] * len(sums), False
                        spool = _spool_of(system, base, stem)
                    parts = []
                    for text, item in zip(texts[low:high], items[low:high], strict=True):
                        if item and listed:
                            parts.append(b",")
                        parts.append(text)
                        listed = item
                    spool.add(b"".join(parts))
                    counts = [n + (pc.sum(batch[c].slice(low, high - low)).as_py() or 0) for n, c in zip(counts, sums, strict=True)]
            if spool is not None:
                yield settled()
                spool = None
        finally:
            if spool is not None:
                spool.drop()

    columns = [*keys, *sums, "stem", "begins", "item", F.col("text").cast("binary").alias("text")]
    return staged(pieces.select(*columns).mapInArrow(write, schema), "written-files")


class _Values:
    """Values of a JSON text one after the other; no more of it is held than a part and the value that is read."""

    scan, white = json.JSONDecoder(strict=False).scan_once, re.compile(r"[ \t\r\n]*")

    def __init__(self, source) -> None:
        self.source, self.decode = source, codecs.getincrementaldecoder("utf-8")("replace").decode
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> None:
        if self.ended:
            raise ValueError("a JSON text is broken or ends before its last value")
        part = self.source.read(max(PART_BYTES, len(self.text) - self.at))
        self.ended = not part
        self.text, self.at = self.text[self.at :] + self.decode(part, self.ended), 0

    def peek(self) -> str:
        """The next character that is not white space."""
        while (mark := self.text[self.at : self.at + 1]) in " \t\r\n":
            self.at = self.white.match(self.text, self.at).end()
            if self.at == len(self.text):
                self._more()
        return mark

    def take(self, marks: str) -> str:
        if (mark := self.peek()) not in marks:
            raise ValueError(f"a JSON text has {mark!r} in place of one of {marks!r}")
        self.at += 1
        return mark

    def value(self) -> tuple[str, object]:
        """The next value as it is written, and what it is."""
        self.peek()
        while True:
            try:
                found, end = self.scan(self.text, self.at)
                # A number could go on.
                if self.ended or (after := self.text[end : end + 1]) and after in " \t\r\n,:]}":
                    break
            except (StopIteration, json.JSONDecodeError):
                pass
            self._more()
        written, self.at = self.text[self.at : end], end
        return written, found


def _stretches(values: _Values, lists: list[str], characters: int) -> Iterator[str]:
    """An object cut into objects: one ends where its part of ``lists`` has come to so many characters."""
    repeated, members = [], []

    def cut(*more: str) -> str:
        return "{" + ",".join([*repeated, *members, *more]) + "}"

    values.take("{")
    mark = "," if values.peek() != "}" else values.take("}")
    while mark == ",":
        key, name = values.value()
        values.take(":")
        if name in lists and values.peek() == "[":
            values.take("[")
            items, size = [], 0
            mark = "," if values.peek() != "]" else values.take("]")
            while mark == ",":
                items.append(values.value()[0])
                size += len(items[-1])
                mark = values.take(",]")
                if size >= characters and mark == ",":
                    yield cut(f"{key}:[{','.join(items)}]")
                    members, items, size = [], [], 0
            members.append(f"{key}:[{','.join(items)}]")
        else:
            written, found = values.value()
            (members if isinstance(found, list | dict) else repeated).append(f"{key}:{written}")
        mark = values.take(",}")
    yield cut()


def read_stretches(files: DataFrame, root: str, lists: list[str], characters: int) -> DataFrame:
    """Read files of one JSON object each in objects of bounded size, whatever the size of a file.

    ``files`` has a ``path`` below ``root`` and ``bytes``; files that are not there give no
    row. Returns a row per stretch, numbered by ``stretch``: the other columns and ``json``,
    an object with the next items of ``lists`` in their order, ended by the first item that brings
    them to ``characters``. Plain members (texts, numbers) are repeated from where
    they stand on, others are in one stretch only. A text that is no such object is an error.
    """
    folder = qualified(files.sparkSession, root)
    kept = [c for c in files.columns if c not in (PATH, "bytes")]
    typed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*kept).schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = system_of(folder)
        for batch in batches:
            for row, path in enumerate(batch[PATH].to_pylist()):
                if system.get_file_info(f"{base}/{path}").type != fs.FileType.File:
                    continue
                own = [batch[c].slice(row, 1) for c in kept]
                with system.open_input_stream(f"{base}/{path}", compression=None) as source:
                    for number, text in enumerate(_stretches(_Values(source), lists, characters)):
                        yield pa.RecordBatch.from_arrays([*own, pa.array([number], pa.int32()), pa.array([text])], names=[*kept, "stretch", "json"])

    # Dealt one by one: a file costs what is in it, not what its name hashes to.
    count, size = files.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(-(-(size or 0) // TASK_BYTES), 4 * files.sparkSession.sparkContext.defaultParallelism)
    dealt = files.repartition(max(1, min(count, tasks, MOST_TASKS)))
    return dealt.select(*kept, PATH).mapInArrow(read, f"{typed}stretch int, json string")


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether any file that a reader would take lies below ``path``; looks no further than the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return False
    root, files = system.makeQualified(folder).toString(), system.listFiles(folder, True)
    while files.hasNext():
        below = files.next().getPath().toString()[len(root) :]
        if not re.search(r"/[._]", below):
            return True
    return False


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below ``root`` and ``length`` of every file there; contents are not read, no folder is no file."""
    if not has_files(spark, root):
        return spark.createDataFrame([], "path string, length bigint")
    folder = qualified(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    below = F.regexp_extract("path", r"\Q" + re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", folder) + r"/\E(.*)$", 1)
    return found.select(below.alias("path"), "length")
