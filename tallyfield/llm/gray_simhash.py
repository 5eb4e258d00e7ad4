"""SimHash near-duplicates through a hierarchical index over fingerprints in Gray order.

Neighbours in Gray order share most bits. The order is cut into runs; a node keeps the bits on which all its
fingerprints agree (mask and pattern), without those its parent has. A search goes down adding the differences on
these bits and leaves a whole group out as soon as the sum is over the limit. The upper nodes route a fingerprint
to the runs it may link to; the lower ones are searched inside a run's task.

Fingerprints are indexed once for each of ``bits + 1`` parts of their bits, rotated to the front. Two that differ in
``bits`` places agree on one whole part, so a search of that order allows no difference in its first part. It
reaches one run or two at any size, where a single order would need more with every doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.seqs import connected_components
from .common import checkpointed, join_hot, slices, small_batches, utf8

MAX_BITS = 2
SHINGLE = 3
FAN = 8
#: Distinct fingerprints in a run, and the most runs; runs grow beyond that, the table of upper nodes does not.
RUN = 4096
MAX_RUNS = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the word 3-shingles' XXH64, a bit set if more than half of them set it; no words: 0."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, text_hash)`` of every row, ``fp`` as a signed long; the other hash tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t) for t in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), b.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    text = F.col(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("text_hash"))
    return plain.mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash(text: Column) -> Column:
    """Of equal texts equal, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def gray_rank(fp: Column) -> Column:
    """The place of a bit string in the reflected Gray sequence, as a long in the same order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Levels of nodes over items in Gray order; an item is a fingerprint, or a run's mask and pattern."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray):
        levels = [(pattern, mask)]
        while len(pattern) > 1:
            at = np.arange(0, len(pattern), FAN)
            common = np.bitwise_and.reduceat(mask, at)
            some, every = np.bitwise_or.reduceat(pattern, at), np.bitwise_and.reduceat(pattern, at)
            mask = common & ~(some ^ every)
            pattern = every & mask
            levels.append((pattern, mask))
        own = []
        for depth, (pattern, mask) in enumerate(levels):
            above = levels[depth + 1][1][np.arange(len(mask)) // FAN] if depth + 1 < len(levels) else np.uint64(0)
            own.append((pattern, mask & ~above))
        self.levels = own[::-1]

    def search(self, queries: np.ndarray, bits: int, lead: np.uint64, first: np.ndarray | None = None):
        """``(query, item)`` with at most ``bits`` differences on the item's mask and none on ``lead``.

        With ``first``, only items from that number on.
        """
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        total = np.zeros(len(queries), np.uint8)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, total = np.repeat(q, FAN), np.repeat(total, FAN)
                near = node < len(pattern)
                if first is not None:  # the node's last item
                    span = FAN ** (len(self.levels) - 1 - depth)
                    near &= (node + 1) * span > first[q]
                node, q, total = node[near], q[near], total[near]
            differ = (queries[q] ^ pattern[node]) & mask[node]
            total = total + np.bitwise_count(differ)
            near = (total <= bits) & (differ & lead == 0)
            node, q, total = node[near], q[near], total[near]
        return q, node


def _parts(bits: int) -> list[tuple[int, np.uint64]]:
    """For each part of the 64 bits: the rotation that brings it to the front, and its mask there."""
    cuts = [64 * k // (bits + 1) for k in range(bits + 2)]
    return [(a, np.uint64(((1 << (b - a)) - 1) << (64 - (b - a)))) for a, b in zip(cuts, cuts[1:])]


def _turned(fp: Column, left: int) -> Column:
    return fp if left == 0 else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def _back(fps: np.ndarray, left: int) -> np.ndarray:
    return fps if left == 0 else (fps >> np.uint64(left)) | (fps << np.uint64(64 - left))


def _route(upper, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [(GrayIndex(*u) if len(u[0]) else None, lead) for u, (_, lead) in zip(upper.value, _parts(bits))]
        for b in batches:
            turns = b.column("turn").to_numpy()
            for turn in np.unique(turns).tolist():
                index, lead = indexes[turn]
                mine = np.flatnonzero(turns == turn)
                for at in range(0, len(mine), 2048):
                    some = mine[at : at + 2048]
                    fps = b.column("fp").to_numpy()[some].view(np.uint64)
                    own = b.column("run").to_numpy()[some].astype(np.int64)
                    q, run_ = index.search(fps, bits, lead, own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), turn, np.int32)), pa.array(run_.astype(np.int32)), pa.array(own[q] != run_),
                         pa.array(fps[q].view(np.int64))],
                        names=["turn", "run", "guest", "fp"],
                    )

    return run


def _roots(root: np.ndarray, some: np.ndarray) -> np.ndarray:
    at = root[some]
    while True:
        up = root[at]
        if np.array_equal(up, at):
            return at
        at = up


def _search_runs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(bits)
        current, members, index, root = None, [], None, None
        out: list[tuple[int, int, int]] = []

        def look(fps: np.ndarray) -> None:
            for at in range(0, len(fps), 512):
                some = fps[at : at + 512]
                q, item = index.search(some, bits, parts[current[0]][1])
                for k, hits in zip(np.unique(q).tolist(), np.split(item, np.flatnonzero(np.diff(q)) + 1)):
                    tops = np.unique(_roots(root, hits))
                    out.extend((current[0], int(some[k]), int(members[t])) for t in tops if members[t] != some[k])
                    root[tops] = tops[0]

        def build() -> None:
            nonlocal members, index, root
            members = np.concatenate(members)
            members = members[np.argsort(_gray(members))]
            index = GrayIndex(members, np.full(len(members), _ALL))
            root = np.arange(len(members))
            look(members)

        def flush() -> pa.RecordBatch:
            found = np.array(out, np.uint64).reshape(-1, 3)
            out.clear()
            for turn, (left, _) in enumerate(parts):
                mine = found[:, 0] == turn
                found[mine, 1:] = _back(found[mine, 1:], left)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in (1, 2)], names=["a", "b"])

        for b in batches:
            turns, runs, guest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("turn", "run", "guest"))
            fps = b.column("fp").to_numpy().view(np.uint64)
            change = np.flatnonzero((np.diff(turns) != 0) | (np.diff(runs) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *change], [*change, len(runs)]):
                if s == e:
                    continue
                if (int(turns[s]), int(runs[s])) != current:
                    if current is not None and index is None:
                        build()
                    current, members, index = (int(turns[s]), int(runs[s])), [], None
                if not guest[s]:
                    members.append(fps[s:e])
                else:
                    if index is None:
                        build()
                    look(fps[s:e])
            yield flush()
        if current is not None and index is None:
            build()
        yield flush()

    return run


def _gray(fps: np.ndarray) -> np.ndarray:
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def link_fingerprints(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: enough pairs of distinct ``fp`` within ``bits`` differences to connect every component.

    Runs are ranges of a Gray order with equal numbers of fingerprints. Only their masks and patterns, at most
    ``MAX_RUNS`` pairs of longs, come to the driver and are broadcast. Each order sends a fingerprint to its own run
    and the later ones with the same first part, mostly none; a run keeps a union of its members, so a dense
    cluster gives links, not pairs.
    """
    spark = distinct.sparkSession
    parts = _parts(bits)
    n = distinct.count()
    runs = min(MAX_RUNS, len(parts) * max(1, -(-n // RUN)))
    turned = distinct.select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("turn"), _turned(F.col("fp"), left).alias("fp")) for t, (left, _) in enumerate(parts)]))
    )
    placed = checkpointed(
        turned.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange(runs, "turn", "rank")
        .select("turn", "fp", F.spark_partition_id().alias("part"))
    )
    nodes = sorted(
        placed.groupBy("turn", "part").agg(F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")).collect()
    )  # one row per run
    if not nodes:
        return spark.createDataFrame([], "a long, b long")
    upper, numbers = [], []
    for turn in range(len(parts)):
        own = [r for r in nodes if r["turn"] == turn]
        every = np.array([r["every"] for r in own], np.int64).view(np.uint64)
        some = np.array([r["some"] for r in own], np.int64).view(np.uint64)
        mask = ~(every ^ some)
        upper.append((every & mask, mask))
        numbers += [(turn, r["part"], k) for k, r in enumerate(own)]
    upper = spark.sparkContext.broadcast(upper)
    number = spark.createDataFrame(numbers, "turn int, part int, run int")
    routed = placed.join(F.broadcast(number), ["turn", "part"]).select("turn", "fp", "run").mapInArrow(
        _route(upper, bits), "turn int, run int, guest boolean, fp long"
    )
    return routed.repartition(len(nodes), "turn", "run").sortWithinPartitions("turn", "run", "guest").mapInArrow(
        _search_runs(bits), "a long, b long"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, text_hash, first)`` for every row.

    Documents link at ``bits`` or fewer differing fingerprint bits; ``component_id`` is the smallest id reachable.
    Null and empty texts have fingerprint zero and link like any other. Rows without an id take part and get the
    component of the others with their links, null if there is none. Repeated rows repeat their result. Equal
    fingerprints are one row from the first step on, so a group of copies does not grow any task. ``first`` names the
    first row of the component, by id, rows without one last, then by ``text_hash``.
    """
    with small_batches(docs.sparkSession):
        prints = checkpointed(fingerprints(docs, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    pairs = checkpointed(link_fingerprints(distinct.select("fp"), bits).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("seq_id")).distinct()
    joined = connected_components(ends, pairs).select(F.col("seq_id").alias("fp"), "cluster")
    grouped = distinct.select("fp", F.col("first").alias("own")).join(joined, "fp")
    least = grouped.groupBy("cluster").agg(F.min("own").alias("least"))
    known = distinct.join(grouped.select("fp", "cluster").join(least, "cluster").drop("cluster"), "fp", "left")
    named = checkpointed(known.select("fp", "n", F.coalesce("least", "first").alias("first")))
    return join_hot(prints, named, "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"),
        "text_hash", "first",
    )


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that are the first of their component in ``groups`` (``near_duplicates``).

    Rows are told apart by id and text, so rows that share an id and no text are judged each; of equal rows one stays.
    """
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    groups = checkpointed(groups.select("doc_id", "text_hash", (own == F.col("first")).alias("stays")))
    same = [F.col(id_col).cast("long").eqNullSafe(F.col("__id")), F.col("__hash") == F.col("__other")]
    names = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__other")]
    later = groups.where(~F.col("stays")).select(*names).distinct()
    again = checkpointed(groups.where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(*names))
    marked = docs.withColumn("__hash", text_hash(F.col(text_col)))
    kept = marked.join(later, same, "left_anti")
    if not again.count():
        return kept.drop("__hash")
    single = kept.join(again, same, "left_anti")
    several = kept.join(again, same, "left_semi").withColumn("__id", F.col(id_col).cast("long")).dropDuplicates(["__id", "__hash"])
    return single.unionByName(several.drop("__id")).drop("__hash")
