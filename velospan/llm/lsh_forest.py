"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on full sets.

Texts with equal shingle sets are one node. Each node's signature is laid out in
several orders; every order is range-sorted over the whole corpus. A region is a run
of neighbours with a common prefix, and its depth adapts: prefixes grow only where
more nodes share them than a region may hold. Inside a region signatures are
compared, and those that agree often enough form candidate groups, emitted as one
row per member rather than as pairs. Groups that overlap are joined into clusters;
full shingle sets are then shipped once per cluster and compared exactly. A cluster
too large for one task is compared region by region first. Nodes of such clusters,
of prefixes that regions divide and of prefixes at a partition's edge are then joined
on their rarest shingles, of which linked sets share one; what that finds between
components is compared on full sets too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.llm.columns import ascii_lower, require, whole_text, words
from velospan.llm.components import components
from velospan.llm.memory import give_back
from velospan.staging import staged

SHINGLE = 5
#: Links need 100 * intersection >= percent * union; this is the percent unless another is given.
PERCENT = 85
#: Values in a signature (one byte each) and sorted orders of it.
VALUES, TREES = 64, 16
#: Least common prefix of a region, and the nodes up to which it is not divided.
LEAST_DEPTH, REGION = 2, 512
#: Nodes and shingles of a cluster that is compared in one task.
CLUSTER_NODES, CLUSTER_SHINGLES = 1024, 2_000_000
#: Partners of one set that are compared in one task, and the parts into which a shingle's sets are dealt.
PARTNERS, SALTS = 256, 16
#: Shingles of the sets whose rarest are looked up together.
BLOCK_SHINGLES = 500_000
ROWS_A_PARTITION = 200_000
_SLICE_WORDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 2**63, VALUES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.stack([_RNG.permutation(VALUES) for _ in range(TREES)])
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_DESCRIPTION = T.StructType().add("n", T.LongType()).add("digest", T.BinaryType()).add("signature", T.BinaryType())


def least_agreement(percent: int) -> int:
    """Signature values that candidates share: 4 deviations below what a link has on average."""
    p = percent / 100
    return round(VALUES * p - 4 * math.sqrt(VALUES * p * (1 - p)))


AGREE = least_agreement(PERCENT)


# -- sets and signatures ----------------------------------------------------------


def word_hashes(text: str) -> Column:
    """64-bit hashes of a text's words, ASCII letters in lower case."""
    return F.transform(words(ascii_lower(whole_text(text))), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return (x ^ (x >> np.uint64(29))) * _GOLDEN


def _shingle_sets(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each list of word hashes."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(lists):
        upto = int(np.searchsorted(offsets, offsets[at] + _SLICE_WORDS, side="right")) - 1
        upto = min(max(upto, at + 1), len(lists))
        base = offsets[at]
        w = values[base : offsets[upto]]
        rolled = np.zeros(max(len(w) - SHINGLE + 1, 0), np.uint64)
        for j in range(SHINGLE):
            rolled = _mixed(rolled + w[j : j + len(rolled)])
        for row in range(at, upto):
            low, high = offsets[row] - base, offsets[row + 1] - base
            if high - low >= SHINGLE:
                yield np.unique(rolled[low : high - SHINGLE + 1])
            elif high > low:
                whole = np.zeros(1, np.uint64)
                for x in w[low:high]:
                    whole = _mixed(whole + x)
                yield _mixed(whole + np.uint64(high - low))
            else:
                yield np.empty(0, np.uint64)
        at = upto


def _signature(shingles: np.ndarray) -> bytes:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, at : at + 4096] * _FACTORS[:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


@F.arrow_udf(_DESCRIPTION)
def _described(lists: pa.Array) -> pa.Array:
    rows = [
        {"n": len(s), "digest": hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "signature": _signature(s)}
        if len(s)
        else {"n": 0, "digest": None, "signature": None}
        for s in _shingle_sets(lists)
    ]
    made = pa.array(rows, pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())]))
    give_back()
    return made


@F.arrow_udf(T.BinaryType())
def _set_bytes(lists: pa.Array) -> pa.Array:
    made = pa.array([s.tobytes() for s in _shingle_sets(lists)], pa.binary())
    give_back()
    return made


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _layouts(signatures: pa.Array) -> pa.Array:
    """Each signature in every tree's order of values."""
    n = len(signatures)
    plain = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(n, VALUES)
    laid = np.ascontiguousarray(plain[:, _ORDERS]).reshape(n * TREES, VALUES)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUES), n * TREES, [None, pa.py_buffer(laid.tobytes())])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * TREES, pa.int32()), flat.cast(pa.binary()))


# -- regions -----------------------------------------------------------------------


def _common_prefix(keys: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before; -1 at the start of a tree."""
    shared = np.full(len(keys), -1)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
        shared[1:][trees[1:] != trees[:-1]] = -1
    return shared


def _regions(shared: np.ndarray, region: int) -> np.ndarray:
    """Number of each row's region: prefixes are lengthened where a region holds too many rows."""
    starts = shared < LEAST_DEPTH
    for depth in range(LEAST_DEPTH + 1, VALUES + 1):
        number = np.cumsum(starts) - 1
        crowded = (np.bincount(number) > region)[number]
        if not crowded.any():
            break
        starts |= crowded & (shared < depth)
    # Equal signatures beyond a region's size: blocks of it, tied to one another by the caller.
    number = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)[number]
    starts |= (np.arange(len(shared)) - first) % region == 0
    return np.cumsum(starts) - 1


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(keys: np.ndarray, region: np.ndarray, agree: int = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one region whose signatures agree in at least ``agree`` values."""
    links: list[tuple[np.ndarray, np.ndarray]] = []
    rows, lag = np.arange(len(keys)), 1
    while True:
        rows = rows[rows + lag < len(keys)]
        rows = rows[region[rows] == region[rows + lag]]
        if not len(rows):
            break
        for part in np.array_split(rows, -(-len(rows) // 100_000)):
            alike = (keys[part] == keys[part + lag]).sum(axis=1) >= agree
            links.append((part[alike], part[alike] + lag))
        lag += 1
    if not links:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])


def _parted(shared: np.ndarray) -> np.ndarray:
    """Rows whose least prefix is divided into regions, or may go on in the partition before or after."""
    number = np.cumsum(shared < LEAST_DEPTH) - 1
    return (np.bincount(number) > REGION)[number] | (number == 0) | (number == number[-1])


def _groups_of(batches: Iterator[pa.RecordBatch], agree: int = AGREE) -> Iterator[pa.RecordBatch]:
    """Candidate groups of one sorted partition: a row per member, with the group's first member.

    Rows without a place name the nodes that may have partners outside their region.
    """
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    trees = table["tree"].to_numpy()
    keys = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(-1, VALUES)
    shared = _common_prefix(keys, trees)
    region = _regions(shared, REGION)
    a, b = _candidates(keys, region, agree)
    root = _settled(len(keys), a, b)
    member = np.zeros(len(keys), bool)
    member[a] = member[b] = True
    rows, roots = np.flatnonzero(member), root[member]
    group = np.char.mod("%d", roots)
    # Blocks of equal signatures: the last row of one with the first of the next.
    tied = np.flatnonzero((shared == VALUES) & np.r_[False, region[1:] != region[:-1]])
    rows = np.concatenate([rows, tied, tied - 1])
    group = np.concatenate([group, np.char.mod("t%d", tied), np.char.mod("t%d", tied)])
    roots = np.concatenate([roots, tied, tied])
    node = table["node"].combine_chunks()
    first = node.take(pa.array(roots))
    place = pa.array([f"{t}:{g}" for t, g in zip(trees[roots].tolist(), group.tolist(), strict=True)], pa.string())
    alone = node.take(pa.array(np.flatnonzero(_parted(shared))))
    place = pa.concat_arrays([place, pa.nulls(len(alone), pa.string())])
    first, members = pa.concat_arrays([first, alone]), pa.concat_arrays([node.take(pa.array(rows)), alone])
    yield pa.RecordBatch.from_arrays([place, first, members], names=["place", "first", "node"])


def candidate_groups(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``grp``, ``first`` and ``node`` of every candidate group of every tree; ``grp`` is null for parted nodes."""
    total = nodes.count()
    rows = nodes.select("node", F.posexplode(_layouts("signature")).alias("tree", "key"))
    partitions = max(8, -(-total * TREES // ROWS_A_PARTITION))
    ordered = rows.repartitionByRange(partitions, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = ordered.mapInArrow(partial(_groups_of, agree=least_agreement(percent)), "place string, first binary, node binary")
    return found.select(F.when(F.col("place").isNotNull(), F.xxhash64("place", "first")).alias("grp"), "first", "node")


# -- exact comparison --------------------------------------------------------------


def exact_components(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The least set that each set reaches over links; every pair that shares a shingle is counted.

    Shingles of one set only are dropped, the others list the sets that hold them, and
    a set's intersections with all sets are one count over its lists.
    """
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    holders, ends = owner[order], np.cumsum(times)
    starts = ends - times
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets)):
        own = column[bounds[i] : bounds[i + 1]]
        own = own[times[own] > 1]
        counts = times[own]
        if not len(own):
            continue
        upto = np.cumsum(counts)
        gather = np.arange(upto[-1]) + np.repeat(starts[own] - (upto - counts), counts)
        shared = np.bincount(holders[gather], minlength=len(sets))
        linked = 100 * shared >= percent * (sizes[i] + sizes - shared)
        labels = np.unique(label[linked])
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
    return label


def _confirmed(table: pa.Table, percent: int) -> pa.Table:
    table = table.sort_by("node")
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    label = exact_components(sets, percent) if len(sets) > 1 else np.zeros(len(sets), int)
    moved = np.flatnonzero(label != np.arange(len(label)))
    node = table["node"].combine_chunks()
    return pa.table({"a": node.take(pa.array(moved)), "b": node.take(pa.array(label[moved]))})


def _links(dealt: DataFrame, percent: int) -> DataFrame:
    """``a`` and ``b``: each set of a ``grp`` and the least one that it reaches there."""

    def confirmed(table: pa.Table) -> pa.Table:
        found = _confirmed(table, percent)
        if table.num_rows > 100:
            give_back()
        return found

    return dealt.groupBy("grp").applyInArrow(confirmed, "a binary, b binary")


def _clusters(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``root`` and whether the cluster is too ``large`` for one task."""
    clusters = components(groups, "first", "node")
    roots = clusters.select("root").distinct().select(F.col("root").alias("node"), "root")
    member = clusters.select("node", "root").union(roots)
    sized = member.join(nodes.select("node", "n"), "node")
    sizes = sized.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    large = (F.col("nodes") > CLUSTER_NODES) | (F.col("shingles") > CLUSTER_SHINGLES)
    return member.join(sizes.select("root", large.alias("large")), "root").select("node", "root", "large")


def _compared_in(groups: DataFrame, member: DataFrame) -> DataFrame:
    """``node`` and the ``grps`` it is compared in: its cluster, or its regions' groups if that is too large."""
    whole = member.filter(~F.col("large")).select("node", F.xxhash64("root").alias("grp"))
    parts = groups.join(member.filter("large"), "node").select("node", "grp")
    return whole.union(parts).distinct().groupBy("node").agg(F.collect_list("grp").alias("grps"))


# -- what regions part -------------------------------------------------------------


def _salted(rows: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of nodes joined on ``shingle``; those of one shingle are dealt to several tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, ["shingle", "salt"], how).drop("salt")


_BLOCK = "block bigint, nodes array<binary>, sizes array<int>, places array<int>, codes array<bigint>, holders array<int>"
_ARROW_BLOCK = pa.schema([
    ("block", pa.int64()), ("nodes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
    ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())),
])
_ARROW_RAREST = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("at", pa.int32()), ("central", pa.float64()), ("shingle", pa.int64())])
_STRETCH = "stretch bigint, block bigint, start bigint, codes array<bigint>, holders array<int>"
_ARROW_STRETCH = pa.schema([("stretch", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))])
_COUNTED = "of_block bigint, start bigint, times array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block of sets: its distinct shingles, how many sets hold each, and every set as places among them."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        nodes, sets = batch["node"].to_pylist(), [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        part = np.cumsum(sizes) // BLOCK_SHINGLES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sets)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            codes, places, holders = np.unique(np.concatenate(sets[low:high]), return_inverse=True, return_counts=True)
            row = [number, nodes[low:high], sizes[low:high], places, codes, holders]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW_BLOCK, strict=True)], schema=_ARROW_BLOCK)
            number += 1


def _stretches(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """The shingles of each block and their holders, cut where one of ``count`` equal stretches of all codes ends."""
    edges = np.array([-(1 << 63) + (i << 64) // count for i in range(1, count)], np.int64)
    for batch in batches:
        for at in range(batch.num_rows):
            codes, holders = batch["codes"][at].values, batch["holders"][at].values
            cuts = np.r_[0, np.searchsorted(codes.to_numpy(), edges), len(codes)]
            held = np.flatnonzero(np.diff(cuts))
            offsets = pa.array(np.r_[cuts[held], len(codes)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (codes, holders)]
            block = np.full(len(held), batch["block"][at].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(block), pa.array(cuts[held]), *lists], schema=_ARROW_STRETCH)


def _times(stretch: pa.Table) -> pa.Table:
    """How many sets of all blocks hold each shingle of a stretch, in the order every block lists them."""
    codes, holders = (stretch[c].combine_chunks() for c in ("codes", "holders"))
    _, place = np.unique(codes.flatten().to_numpy(), return_inverse=True)
    times = np.bincount(place, holders.flatten().to_numpy())[place].astype(np.int64)
    offsets = np.r_[0, np.cumsum(codes.value_lengths().to_numpy())].astype(np.int32)
    return pa.table({"of_block": stretch["block"], "start": stretch["start"], "times": pa.ListArray.from_arrays(offsets, times)})


def _rarest_of(block: pa.Table, counted: pa.Table, percent: int) -> pa.Table:
    """The rarest shingles of each set of a block and their places among its shingles, less those of one set only."""
    rows: list[tuple] = []
    if block.num_rows:
        nodes, sizes, places, codes = (block[c][0].values for c in ("nodes", "sizes", "places", "codes"))
        times = np.concatenate([x.values.to_numpy() for x in counted.sort_by("start")["times"]])
        order, at = codes.to_numpy(), 0
        for node, n in zip(nodes.to_pylist(), sizes.to_pylist(), strict=True):
            own = places.to_numpy()[at : at + n]
            at += n
            held, length = times[own], n - -(-n * percent // 100) + 1
            first = own[np.lexsort((order[own], held))[:length]]
            shared = np.flatnonzero(times[first] > 1)
            rows += [(node, n, i, float(held.mean()), code) for i, code in zip(shared.tolist(), order[first[shared]].tolist(), strict=True)]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_RAREST, strict=True)], schema=_ARROW_RAREST)


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each set, as many as make linked sets share one, less those of one set only.

    ``central`` is how many sets hold a shingle of this one, on average, and ``at`` how many
    of this set's shingles are rarer. A block of sets lists each of its shingles once, so one
    that stands in every set meets the others once a block; lists travel in stretches of all
    codes, and what a block or a stretch holds is bounded.
    """
    # As many partitions as make blocks of their size, however finely the sets lie.
    size = sets.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    count = 1 + int(size // BLOCK_SHINGLES)
    dealt = sets.select("node", "shingles").coalesce(count)
    table = staged(dealt.mapInArrow(_blocks, _BLOCK), "set-blocks")
    cut = table.select("block", "codes", "holders").mapInArrow(partial(_stretches, count=count), _STRETCH)
    times = cut.groupBy("stretch").applyInArrow(_times, _COUNTED)

    def rarest(block: pa.Table, counted: pa.Table) -> pa.Table:
        return _rarest_of(block, counted, percent)

    schema = "node binary, n int, at int, central double, shingle bigint"
    return table.drop("holders").groupBy("block").cogroup(times.groupBy("of_block")).applyInArrow(rarest, schema)


def _pair_links(pairs: DataFrame, sets: DataFrame, total: int, percent: int) -> DataFrame:
    """Links among the sets of ``pairs``: those of one ``a`` are compared in parts."""
    part = F.pmod(F.xxhash64("b"), F.lit(max(1, total // PARTNERS)))
    dealt = pairs.select(F.xxhash64("a", part).alias("grp"), "a", "b")
    members = dealt.select("grp", F.explode(F.array("a", "b")).alias("node")).distinct()
    return staged(_links(members.join(sets.select("node", "shingles"), "node"), percent), "set-links")


def parted_links(sets: DataFrame, links: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links that make the components of ``links`` exact for ``sets``: ``node`` and ``shingles``.

    First every set is compared with the most central one of each of its rarest shingles,
    which is linear in the sets and settles stars and crowds. Pairs are then made only
    between components, and only on a shingle behind which both sets have enough left:
    the rarest one that linked sets share is followed by all others that they share.
    """
    total = sets.count()
    rarest = staged(_rarest(sets, percent), "set-rarest")
    pivots = rarest.groupBy("shingle").agg(F.max(F.struct("central", "node", "n")).alias("p"))
    pivots = staged(pivots.select("shingle", F.col("p.node").alias("a"), F.col("p.n").alias("a_n")), "set-pivots")
    whole = F.col("n").cast("bigint"), F.col("a_n").cast("bigint")
    alike = 100 * F.least(*whole) >= percent * F.greatest(*whole)
    spokes = _salted(rarest, pivots).filter((F.col("node") != F.col("a")) & alike)
    first = _pair_links(spokes.select("a", F.col("node").alias("b")).distinct(), sets, total, percent)

    rooted = components(links.union(first))
    root = F.coalesce("root", "node").alias("root")
    labelled = staged(rarest.join(rooted, "node", "left").select("shingle", "node", "n", "at", root), "set-labelled")
    heads = pivots.select("shingle", F.col("a").alias("node")).join(rooted, "node", "left")
    heads = heads.select("shingle", F.coalesce("root", "node").alias("a_root"))
    others = _salted(labelled, heads).filter("root <> a_root")
    others = others.select("shingle", *[F.col(c).alias(name) for c, name in (("node", "a"), ("n", "a_n"), ("at", "a_at"), ("root", "a_root"))])
    left = F.least(whole[0] - F.col("at"), whole[1] - F.col("a_at"))
    enough = (100 + percent) * left >= percent * (whole[0] + whole[1])
    across = _salted(labelled, staged(others, "set-others")).filter((F.col("root") != F.col("a_root")) & enough)
    pairs = across.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    return first.union(_pair_links(pairs, sets, total, percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``root``, ``n_shingles``, ``component_id`` and ``kept``.

    ``root`` tells components apart even where ids repeat; it is null without shingles.
    Texts are linked whose sets share ``percent`` of their union.
    A text's set holds its distinct five-word shingles; with fewer words it is the
    whole sequence as one. Texts without words, null ones too, have no shingle and are
    linked with nothing. ``component_id`` is the least id in the component; rows with
    a null id take part in it but never name it, and where all ids are null it is
    null and the rows are kept. Repeated rows are copies of one another.
    """
    require(docs, doc_id, text)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("text_hash", F.xxhash64("text"))
    described = plain.select("doc_id", "text_hash", _described(word_hashes("text")).alias("d"))
    table = staged(described.select("doc_id", "text_hash", "d.*"), "shingle-sets")

    origin = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    nodes = table.filter("n > 0").groupBy(F.col("digest").alias("node"))
    nodes = nodes.agg(F.max("n").alias("n"), F.max("signature").alias("signature"), origin.alias("origin"))
    nodes = staged(nodes.select("node", "n", "signature", "origin.doc_id", "origin.text_hash"), "set-nodes")

    found = staged(candidate_groups(nodes, percent), "set-groups")
    groups = found.filter("grp IS NOT NULL")
    member = staged(_clusters(groups, nodes), "set-clusters")
    named = nodes.select("node", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    wanted = staged(_compared_in(groups, member).join(named, "node"), "set-compared")
    same = plain["doc_id"].eqNullSafe(F.col("of_id")) & (plain["text_hash"] == F.col("of_hash"))
    # Texts are many times larger than the table of nodes at every size, and are dealt out alike at all.
    sets = plain.join(wanted.hint("shuffle_merge"), same).select("node", "grps", _set_bytes(word_hashes("text")).alias("shingles"))
    sets = sets.groupBy("node").agg(F.first("grps").alias("grps"), F.first("shingles").alias("shingles"))
    links = staged(_links(sets.select("node", "shingles", F.explode("grps").alias("grp")), percent), "set-links")

    parted = found.filter("grp IS NULL").select("node").union(member.filter("large").select("node")).distinct()
    parted = staged(parted.join(named, "node"), "set-parted")
    if not parted.isEmpty():
        sets = plain.join(parted, same).select("node", _set_bytes(word_hashes("text")).alias("shingles"))
        sets = staged(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "parted-sets")
        links = links.union(parted_links(sets, links, percent))
    rooted = components(links)

    labelled = nodes.select("node", "doc_id").join(rooted, "node", "left")
    labelled = labelled.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least_of = labelled.join(least, "root").select(F.col("node").alias("digest"), "root", "component_id")
    joined = table.join(staged(least_of, "set-components"), "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    result = joined.select("doc_id", "text_hash", "root", F.col("n").alias("n_shingles"), component.alias("component_id"))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return result.withColumn("kept", kept)


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of ``docs``: its least id's first text.

    Of rows that repeat id and text one stays; an id that names several unlinked texts
    keeps one row for each.
    """
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    inputs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    judged = staged(near_duplicates(docs, doc_id, text, percent).filter("kept"), "kept-rows")
    chosen = judged.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("key"))
    keys = judged.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    picked = keys.join(chosen.select(F.col("root").alias("_root"), "key"), F.col("root") == F.col("_root"), "left")
    named = F.struct("doc_id", "text_hash").eqNullSafe(F.col("key"))
    picked = picked.filter(F.col("root").isNull() | named)
    picked = picked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "root", "times")
    keyed = inputs.withColumn("_of_hash", F.xxhash64(F.col(names[text]).cast("string")))
    same = keyed[names[doc_id]].eqNullSafe(F.col("_id")) & (F.col("_of_hash") == F.col("_hash"))
    repeated = F.col("root").isNotNull() & (F.col("times") > 1)
    once = keyed.join(picked.filter(~repeated), same, "left_semi")
    first_of = keyed.join(picked.filter(repeated), same).dropDuplicates(["_id", "_hash"])
    every = once.select(*names.values()).union(first_of.select(*names.values()))
    return every.select(*[F.col(n).alias(c) for c, n in names.items()])
