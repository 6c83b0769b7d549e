"""Landed trip files: flat CSV, ZIP archives of CSV members, duplicate members.

Both readers give positional raw rows (file, source_member, source_row_number,
header, fields), which ``operators.normalize`` maps to the canonical trip.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velospan.sources.files import system_of
from velospan.staging import staged

# Encodings tried for archive members, in order; the mark of UTF-8 and the
# polynomial of the checksum, lowest power first.
MEMBER_ENCODINGS = ("utf-8", "windows-1252")
BOM = b"\xef\xbb\xbf"
CRC_POLYNOMIAL = 0xEDB88320

_CSV = {"escape": '"', "quote": '"'}
#: Text of a batch of archive records, tasks that members are dealt to at most, and bytes of members for one task.
_BATCH_CHARACTERS, MEMBER_TASKS, MEMBER_BYTES = 4_000_000, 10_000, 32 << 20
_DIRECTORY = pa.schema([("file", pa.string()), ("source_member", pa.string()), ("file_size", pa.int64()), ("crc32", pa.int64()), ("error", pa.string())])
_RECORDS = pa.schema([("file", pa.string()), ("source_member", pa.string()), ("number", pa.int64()), ("record", pa.string()), ("header_line", pa.string()), ("error", pa.string())])


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Non-empty lines with the place they stand at: file, block of the file, order in the scan."""
    text = spark.read.text(paths).filter(F.length("value") > 0)
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


@dataclass(frozen=True)
class CsvScan:
    """Positioned lines of flat files, written once, and the profile of their blocks.

    Row numbers are differences of places in ``lines``. Both tables come from one scan:
    a second scan may split files in other places, and blocks would then not agree.
    """

    lines: DataFrame
    profile: DataFrame


def scan_csv(spark: SparkSession, paths: list[str]) -> CsvScan:
    lines = staged(_lines(spark, paths), "csv-lines")
    return CsvScan(lines, profile_csv(lines))


def profile_csv(lines: DataFrame) -> DataFrame:
    """One row per block of every file: lines before it, its first scan number, the file's header line.

    One pass with partial aggregation. ``bad_bytes`` marks files that are not
    UTF-8 and ``multiline`` files with a quoted line break.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = (
        lines.groupBy("file", "block")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.min("seq").alias("first_seq"),
            F.min_by(F.when(F.col("block") == 0, F.col("value")), "seq").alias("header_line"),
            F.bool_or(~F.is_valid_utf8("value")).alias("bad_bytes"),
            F.bool_or(quotes % 2 == 1).alias("multiline"),
        )
    )
    before = W.partitionBy("file").orderBy("block")
    whole = W.partitionBy("file")
    return staged(
        blocks.select(
            "file",
            "block",
            "first_seq",
            F.coalesce(F.sum("lines").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
            F.first("header_line", ignorenulls=True)
            .over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            .alias("header_line"),
            F.bool_or("bad_bytes").over(whole).alias("bad_bytes"),
            F.bool_or("multiline").over(whole).alias("multiline"),
        ),
        "csv-profile",
    )


def _width(profile: DataFrame) -> int:
    """Columns to parse: the widest header (commas + 1 is an upper bound)."""
    commas = F.length("header_line") - F.length(F.replace("header_line", F.lit(","), F.lit("")))
    widest = profile.agg(F.max(commas + 1)).first()[0]
    return widest or 1


def _parsed(line: Column, width: int, **options: bool) -> Column:
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(line, F.lit(", ".join(f"{name} STRING" for name in names)), {**_CSV, **{k: str(v).lower() for k, v in options.items()}})
    return F.transform(F.array(parsed), lambda row: F.array(*[row[name] for name in names]))[0]


def _header(cells: Column) -> Column:
    """Header cells by place: blanks between names stay, so that names keep their columns."""
    named = F.transform(cells, lambda cell, i: F.when(cell.isNotNull(), i + 1).otherwise(0))
    own = F.slice(cells, 1, F.coalesce(F.array_max(named), F.lit(0)))
    return F.transform(own, lambda cell: F.coalesce(cell, F.lit("")))


def read_trip_csv(spark: SparkSession, paths: list[str], scan: CsvScan | None = None) -> DataFrame:
    """Rows of flat CSV files with any mix of headers, all text, empty text as null.

    Files are split like any text file: row numbers come from the block profile,
    not from a window over the file, and a line of a block without one is an error.
    Files with quoted line breaks are read in blocks too (``_quoted_records``). Files that
    are not UTF-8 are left out (``csv_headers`` marks them).
    """
    scan = scan_csv(spark, paths) if scan is None else scan
    profile = scan.profile
    width = _width(profile)
    usable = profile.filter(~F.col("bad_bytes"))
    header = _header(_parsed(F.regexp_replace("header_line", "^\\ufeff", ""), width))

    known = profile.select("file", "block", "first_seq", "earlier", "bad_bytes", "multiline", header.alias("header"))
    number = F.col("earlier") + F.col("seq") - F.col("first_seq")
    unknown = F.raise_error(F.concat(F.lit("no profile for a block of "), "file"))
    checked = F.when(number >= 0, number).otherwise(unknown.cast("bigint"))
    rows = (
        scan.lines.join(known, ["file", "block"], "left")
        # Tied to the row, so that no filter is moved below and drops what should be an error.
        .withColumn("source_row_number", F.when(F.monotonically_increasing_id() >= 0, checked))
        .filter(~F.col("bad_bytes") & ~F.col("multiline") & (F.col("source_row_number") > 0))
        .select(
            "file",
            F.lit(None).cast("string").alias("source_member"),
            "source_row_number",
            "header",
            _parsed(F.col("value"), width).alias("fields"),
        )
    )
    # A list of file names, one per file with quoted line breaks.
    broken = [row.file for row in usable.filter("multiline").select("file").distinct().toLocalIterator()]
    if broken:
        rows = rows.unionByName(_read_multiline(spark, broken, width))
    return rows


# One record field after another as the reader takes them: quoted (a quote inside is doubled; what
# follows the closing quote belongs to the field) or plain (a quote inside is an ordinary character).
_REST = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_REST}"[^,]*+|[^",][^,]*+)?'
_OPENED = rf'(?:{_FIELD},)*+"{_REST}'
#: Lines that end inside a quoted field, if they begin outside of one, or inside.
_OPENS, _STAYS_OPEN = rf"^{_OPENED}$", rf'^{_REST}(?:"[^,]*+,{_OPENED})?$'
_OPEN, _STAYS = re.compile(_OPENS).search, re.compile(_STAYS_OPEN).search


def _with_state(rows: DataFrame, keys: list[str], order: str, ends: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Add the state (0 outside, 1 inside a quoted field) before each row, if the first row begins in 0, or in 1.

    ``ends`` name the state behind a row that begins in 0, or in 1. Rows that end in one
    state whatever they begin in settle it; the others keep it or turn it.
    """
    turns = (F.col(ends[0]) == 1) & (F.col(ends[1]) == 0)
    window = W.partitionBy(*keys).orderBy(order)
    upto, before = (window.rowsBetween(W.unboundedPreceding, last) for last in (W.currentRow, -1))
    turned = rows.withColumn("_turn", turns.cast("int")).withColumn("_turns", F.sum("_turn").over(upto))
    settled = F.when(F.col(ends[0]) == F.col(ends[1]), F.struct(F.col(ends[0]).alias("state"), "_turns"))
    known = turned.withColumn("_known", F.last(settled, ignorenulls=True).over(before))
    since = F.col("_turns") - F.col("_turn") - F.coalesce("_known._turns", F.lit(0))
    states = {name: (F.coalesce("_known.state", F.lit(first)) + since) % 2 for first, name in enumerate(names)}
    return known.withColumns(states).drop("_turn", "_turns", "_known")


def _quoted_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, number, record): the records of files with quoted line breaks, numbered from 0 in each file.

    Files are read in blocks like any text. A line either opens or closes a quoted field
    or leaves it as it is, so a block turns the state it begins in into one it ends in:
    the states of blocks are scanned in order, and every line learns whether it begins a
    record. Only lines of records with a line break meet again, wherever they were read.
    """
    text = spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("value").endswith("\r").alias("cr"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    ends = {name: F.col("line").rlike(shape).cast("int") for name, shape in (("e0", _OPENS), ("e1", _STAYS_OPEN))}
    lines = staged(text.withColumns(ends), "quoted-lines")
    inside = _with_state(lines, ["file", "block"], "seq", ("e0", "e1"), ("s0", "s1"))
    upto = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    for first in ("0", "1"):
        # A blank line is a record's only inside quotes.
        begins = ((F.col(f"s{first}") == 0) & (F.length("line") > 0)).cast("bigint")
        after = F.when(F.col(f"s{first}") == 0, F.col("e0")).otherwise(F.col("e1"))
        inside = inside.withColumn(f"n{first}", F.sum(begins).over(upto)).withColumn(f"a{first}", after)
    inside = staged(inside, "quoted-states")

    last = [F.max_by(c, "seq").alias(c) for c in ("a0", "a1", "n0", "n1")]
    blocks = inside.groupBy("file", "block").agg(*last, F.min_by("cr", "seq").alias("cr"))
    blocks = _with_state(blocks, ["file"], "block", ("a0", "a1"), ("state", "_"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    own = F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1"))
    # The first line tells how a file ends its lines; such ends are read as line feeds inside quotes too.
    crlf = F.first("cr").over(W.partitionBy("file").orderBy("block")).alias("crlf")
    blocks = blocks.select("file", "block", "state", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("earlier"), crlf)

    def of(name: str) -> Column:
        return F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = inside.join(blocks, ["file", "block"]).select(
        "file", "block", "seq", "line", (F.col("cr") & ~F.col("crlf")).alias("cr"), (F.col("earlier") + of("n") - 1).alias("number"), of("s").alias("open"), of("a").alias("opens")
    )
    single = (F.col("open") == 0) & (F.col("opens") == 0)
    whole = placed.filter(single & (F.length("line") > 0)).select("file", "number", F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq", "line", "cr", "opens")))
    broken = placed.filter(~single & (F.col("number") >= 0)).groupBy("file", "number").agg(pieces.alias("p"))
    joined = F.aggregate(
        F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))),
        F.struct(F.col("p.line")[0].alias("text"), F.col("p.cr")[0].alias("cr")),
        lambda acc, x: F.struct(
            F.concat(acc["text"], F.when(acc["cr"], F.lit("\r\n")).otherwise(F.lit("\n")), x["line"]).alias("text"), x["cr"].alias("cr")
        ),
        lambda acc: acc["text"],
    )
    return whole.unionByName(broken.select("file", "number", joined.alias("record")))


def _read_multiline(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    records = staged(_quoted_records(spark, paths), "csv-records")
    plain = F.when(F.col("number") == 0, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    parsed = records.select("file", F.col("number").alias("source_row_number"), _parsed(plain, width, multiLine=True).alias("fields"))
    headers = parsed.filter("source_row_number = 0").select("file", _header(F.col("fields")).alias("header"))
    rows = parsed.filter("source_row_number > 0").join(headers, "file")
    return rows.select("file", F.lit(None).cast("string").alias("source_member"), "source_row_number", "header", "fields")


def csv_headers(profile: DataFrame) -> DataFrame:
    """(file, header, bad_bytes), one row per flat file."""
    width = _width(profile)
    header = _header(_parsed(F.regexp_replace("header_line", "^\\ufeff", ""), width))
    return profile.groupBy("file").agg(
        F.first(header).alias("header"), F.first("bad_bytes").alias("bad_bytes")
    )


def _advanced(crc: int, by: int) -> int:
    """The part that a checksum adds to one of ``by`` more bytes: times x to the power of 8 * ``by`` modulo the polynomial."""
    factor, power = crc, 1 << 30  # The power is x; the highest bit stands for x to the power of 0.
    bits = 8 * by
    while bits:
        if bits & 1:
            factor = _times(factor, power)
        power = _times(power, power)
        bits >>= 1
    return factor


def _times(a: int, b: int) -> int:
    """Product of two polynomials over single bits, modulo the checksum's polynomial."""
    product = 0
    for place in range(31, -1, -1):
        if (b >> place) & 1:
            product ^= a
        a = (a >> 1) ^ (CRC_POLYNOMIAL if a & 1 else 0)
    return product


def joined_crc(first: int, second: int, second_length: int) -> int:
    """The checksum of two byte strings in a row, from theirs and the length of the second."""
    return _advanced(first, second_length) ^ second


_BLOCK_CRC = pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("crc", pa.int64()), ("length", pa.int64())])


def _block_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A checksum for the lines of each block, with the line feeds between them, in the order they are read."""
    key, crc, length = None, 0, 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, crc, length), _BLOCK_CRC, strict=True)], schema=_BLOCK_CRC)

    for batch in batches:
        files, sizes, blocks = (batch[c].to_pylist() for c in ("file", "size", "block"))
        starts = [0, *(i for i in range(1, len(files)) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])), len(files)]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            if low == high:
                continue
            own = (files[low], sizes[low], blocks[low])
            lines = b"\n".join(batch["line"].slice(low, high - low).to_pylist())
            if own == key:
                crc, length = zlib.crc32(b"\n" + lines, crc), length + 1 + len(lines)
            else:
                if key is not None:
                    yield told()
                key, crc, length = own, zlib.crc32(lines), len(lines)
    if key is not None:
        yield told()


def _file_checksum(blocks: pa.Table) -> pa.Table:
    """A file's checksum from those of its blocks: line feeds stand between them, and where its size says so, behind."""
    blocks = blocks.sort_by("block")
    crc, length = 0, 0
    for at, (more, own) in enumerate(zip(blocks["crc"].to_pylist(), blocks["length"].to_pylist(), strict=True)):
        if at:
            crc, length = zlib.crc32(b"\n", crc), length + 1
        crc, length = joined_crc(crc, more, own), length + own
    size = blocks["size"][0].as_py()
    # Readers leave out a mark of the encoding at the start, and the last line feed.
    missing = size - length
    if missing >= len(BOM):
        crc, length = joined_crc(zlib.crc32(BOM), crc, length), length + len(BOM)
    if size > length:
        crc, length = zlib.crc32(b"\n", crc), length + 1
    if size != length:
        raise ValueError(f"{blocks['file'][0]} has {size} bytes, but {length} were read")
    return pa.table({"file": [blocks["file"][0].as_py()], "file_size": [size], "crc32": [crc]})


def csv_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, file_size, crc32) of flat files, of any size.

    Files are read in blocks like any text, each block has a checksum of its own, and
    those of a file are joined by the rule for byte strings in a row: no task holds a file.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )
    blocks = lines.mapInArrow(_block_checksums, "file string, size bigint, block bigint, crc bigint, length bigint")
    return blocks.groupBy("file").applyInArrow(_file_checksum, "file string, file_size bigint, crc32 bigint")


# -- archives ------------------------------------------------------------------


def _opened(path: str) -> zipfile.ZipFile:
    """An archive of which only the parts that are asked for are read."""
    system, inside = system_of(re.sub(r"^file:/+", "file:///", path))
    try:
        return zipfile.ZipFile(io.BufferedReader(system.open_input_file(inside), buffer_size=1 << 18))
    except pa.ArrowInvalid as problem:
        # Too short to hold the end of an archive.
        raise zipfile.BadZipFile("File is not a zip file") from problem


def _members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [m for m in archive.infolist() if not m.is_dir() and m.filename.lower().endswith(".csv")]


def zip_directory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV members of every archive: file, source_member, file_size, crc32, error.

    Only an archive's end and its list of members are read, whatever its size. A file
    that is not a readable archive gives one row with its ``error``.
    """

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                try:
                    with _opened(path) as archive:
                        rows = [(path, m.filename, m.file_size, m.CRC, None) for m in _members(archive)]
                except zipfile.BadZipFile as problem:
                    rows = [(path, None, None, None, str(problem))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIRECTORY, strict=True)], schema=_DIRECTORY)

    archives = spark.read.format("binaryFile").load(paths).select("path")
    schema = "file string, source_member string, file_size bigint, crc32 bigint, error string"
    return archives.mapInArrow(list_members, schema)


def duplicate_members(directory: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Archive members whose size and checksum equal those of a landed flat file."""
    same = ["file_size", "crc32"]
    return directory.join(fingerprints.select(*same).distinct(), same, "left_semi")


def unique_members(directory: DataFrame, fingerprints: DataFrame) -> DataFrame:
    same = ["file_size", "crc32"]
    listed = directory.filter(F.col("source_member").isNotNull())
    return listed.join(fingerprints.select(*same).distinct(), same, "left_anti")


def _encoding_of(archive: zipfile.ZipFile, member: str) -> str:
    """The first encoding the whole member decodes with, found without holding it."""
    for encoding in MEMBER_ENCODINGS:
        try:
            with archive.open(member) as raw, io.TextIOWrapper(raw, encoding=encoding, newline="") as text:
                while text.read(1 << 20):
                    pass
            return encoding
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{member} decodes in none of {MEMBER_ENCODINGS}")


def _records(lines: Iterator[str]) -> Iterator[str]:
    """Lines of a CSV text put together where a quoted field goes on; blank lines are no records."""
    held: list[str] = []
    for line in lines:
        if not held and '"' not in line:
            plain = line.rstrip("\r\n")
            if plain:
                yield plain
            continue
        held.append(line)
        if not (_STAYS if len(held) > 1 else _OPEN)(line.rstrip("\r\n")):
            yield "".join(held).rstrip("\r\n")
            held = []
    if held:
        yield "".join(held).rstrip("\r\n")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of every member as text, numbered from 0 and with its first one, in batches of bounded size."""
    for batch in batches:
        for path, name in zip(batch["file"].to_pylist(), batch["source_member"].to_pylist(), strict=True):
            first = None

            def rows(numbers: list, texts: list, error: str | None = None) -> pa.RecordBatch:
                nonlocal first
                n = len(numbers)
                if numbers and numbers[0] == 0:
                    first = texts[0]
                columns = [[path] * n, [name] * n, numbers, texts, [first] * n, [error] * n]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)

            numbers, texts, size = [], [], 0
            try:
                with _opened(path) as archive:
                    encoding = _encoding_of(archive, name)
                    with archive.open(name) as raw, io.TextIOWrapper(raw, encoding=encoding, newline="") as text:
                        for number, record in enumerate(_records(text)):
                            numbers.append(number)
                            texts.append(record)
                            size += len(record)
                            if size > _BATCH_CHARACTERS:
                                yield rows(numbers, texts)
                                numbers, texts, size = [], [], 0
                yield rows(numbers, texts)
            except (ValueError, zipfile.BadZipFile, KeyError) as problem:
                yield rows([None], [None], str(problem))


def _dealt(members: DataFrame) -> DataFrame:
    """Members dealt out one by one, to as many tasks as their bytes are worth: one costs what is in it, not what its name hashes to."""
    sized = "file_size" in members.columns
    count, size = members.agg(F.count(F.lit(1)), F.sum("file_size") if sized else F.lit(None)).first()
    tasks = count if size is None else max(-(-size // MEMBER_BYTES), 4 * members.sparkSession.sparkContext.defaultParallelism)
    return members.repartition(max(1, min(count, tasks, MEMBER_TASKS))).select("file", "source_member")


def read_zip_members(spark: SparkSession, paths: list[str], members: DataFrame | None = None) -> DataFrame:
    """Rows of the CSV members of archives, as ``read_trip_csv`` gives them, plus ``error``.

    ``members`` (file, source_member) limits what is decoded. Every member is read on its
    own, from its own range of the archive, so members of one archive unpack side by side
    and no archive is held. An unreadable member gives one row with ``error`` set.
    """
    if members is None:
        members = zip_directory(spark, paths).filter(F.col("source_member").isNotNull())
    dealt = _dealt(staged(members.select("file", "source_member", *(c for c in ["file_size"] if c in members.columns)), "zip-members"))
    schema = "file string, source_member string, number bigint, record string, header_line string, error string"
    records = staged(dealt.mapInArrow(_unpacked, schema), "zip-records")
    commas = F.length("record") - F.length(F.replace("record", F.lit(","), F.lit("")))
    first = records.filter("number = 0")
    width = first.agg(F.max(commas + 1)).first()[0] or 1
    # Many members have the same header: records meet its cells by its text, few rows that the planner can broadcast.
    header = _header(_parsed(F.regexp_replace("header_line", "^\ufeff", ""), width, multiLine=True)).alias("header")
    headers = staged(first.select("header_line").distinct().select("header_line", header), "zip-headers")
    rows = records.filter("number > 0 OR error IS NOT NULL").join(headers, "header_line", "left")
    fields = F.when(F.col("error").isNull(), _parsed(F.col("record"), width, multiLine=True)).alias("fields")
    return rows.select("file", "source_member", F.col("number").alias("source_row_number"), "header", fields, "error")
