"""Equal-depth draws without replacement, and their exact expectations.

The depth of a sample is divided over its leaves (cells dealt by a hash, a bounded number each). In a leaf of bounded reads
each draw picks distinct ones by rejection, many draws at a time. In a leaf of more reads, or where many are drawn of few
cells, no read is listed: the number is divided over halves of halves of its cells, down to single ones, each time by a
hypergeometric draw of how many fall into the left half, and branches that get nothing end. Draws are seeded by
(seed, sample, leaf), and a leaf's cells are sorted, so a task that runs again draws the same.

Averages over all draws need none: counts of a cell are hypergeometric, and richness, coverage, Shannon entropy and
Bray-Curtis similarity at equal depth are sums over cells, or over pairs of cells of independent samples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import log_factorial, log_falling
from ..session import broadcast_if_small, checkpointed, written
from .diversity import block_products

LEAF_CELLS = 4096  # cells of a leaf aimed at; a sample of more is divided over several leaves
BLOCK_ITERS = 128  # iterations that a task holds at a time
_LIMIT = 10**9  # the library's hypergeometric draws take populations below this
_PICK_READS = 1 << 21  # reads of a leaf up to which single ones are picked
_MARKS = 1 << 18  # units of all draws that are marked at a time


# ---------------------------------------------------------------- one split


def _left(rng: np.random.Generator, left: np.ndarray, right: np.ndarray, take: np.ndarray) -> np.ndarray:
    """How many of ``take`` units drawn from ``left + right`` fall into the left part."""
    small = (left < _LIMIT) & (right < _LIMIT)
    out = np.empty(len(take), np.int64)
    out[small] = rng.hypergeometric(left[small], right[small], take[small])
    for i in np.flatnonzero(~small).tolist():
        # distinct places of the fewer of the drawn and the others, among all; places below ``left`` fall there
        total = int(left[i] + right[i])
        n = min(int(take[i]), total - int(take[i]))
        places = np.zeros(0, np.int64)
        while len(places) < n:
            places = np.concatenate([places, rng.integers(0, total, n - len(places))])
            places = places[np.sort(np.unique(places, return_index=True)[1])]  # the first of equal places, in order
        hit = int((places < left[i]).sum())
        out[i] = hit if n == take[i] else int(left[i]) - hit
    return out


def split(sizes: np.ndarray, takes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(draw, cell, number)`` of all cells hit, if draw ``i`` takes ``takes[i]`` units of cells of these sizes.

    Halves are split level by level for all draws at once; the result is sorted by draw and cell.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    draw = np.flatnonzero(takes)
    k = np.asarray(takes, np.int64)[draw]
    lo, hi = np.zeros(len(draw), np.int64), np.full(len(draw), len(sizes), np.int64)
    done: list[np.ndarray] = []
    while len(draw):
        single = hi - lo == 1
        if single.any():
            done.append(np.stack([draw[single], lo[single], k[single]]))
            draw, lo, hi, k = (x[~single] for x in (draw, lo, hi, k))
        mid = (lo + hi) >> 1
        x = _left(rng, before[mid] - before[lo], before[hi] - before[mid], k)
        draw, lo, hi, k = (np.concatenate(p) for p in ((draw, draw), (lo, mid), (mid, hi), (x, k - x)))
        some = k > 0
        draw, lo, hi, k = draw[some], lo[some], hi[some], k[some]
    if not done:
        return (np.zeros(0, np.int64),) * 3
    found = np.concatenate(done, axis=1)
    found = found[:, np.lexsort((found[1], found[0]))]
    return found[0], found[1], found[2]


def pick(sizes: np.ndarray, takes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Units that draw ``i`` has of every cell, draws x cells, if it takes ``takes[i]`` of cells of these sizes.

    Units are picked one by one; one that its draw has already is picked again, so every set of units is as likely.
    Where a draw takes over half of all, those it leaves are picked.
    """
    total, cells = int(sizes.sum()), len(sizes)
    few = np.minimum(takes, total - takes)
    out = np.empty((len(takes), cells), np.int64)
    step = max(1, min(len(takes), _MARKS // max(total, 1)))
    of = np.repeat(np.arange(cells, dtype=np.int32), sizes)
    mark = np.full(step * total, -1, np.int32)  # the last pick of every unit of a draw; those of earlier steps do not count
    used = 0
    for at in range(0, len(takes), step):
        want = few[at : at + step]
        draw = np.repeat(np.arange(len(want)), want)
        unit = rng.integers(0, max(total, 1), len(draw), np.int32)
        place = draw * total + unit
        own = np.arange(used, used + len(draw), dtype=np.int32)
        mark[place] = own
        again = np.flatnonzero(mark.take(place) != own)
        while len(again):
            unit[again] = rng.integers(0, total, len(again), np.int32)
            place = draw[again] * total + unit[again]
            free = mark[place] < used
            mark[place[free]] = own[again[free]]
            again = again[~free | (mark[place] != own[again])]
        used += len(draw)
        hit = draw * cells + of.take(unit)
        out[at : at + step] = np.bincount(hit, minlength=len(want) * cells).reshape(len(want), cells)
    turn = takes > few
    out[turn] = sizes - out[turn]
    return out


def numbers(sizes: np.ndarray, takes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Units that each draw has of every cell, draws x cells, by ``pick`` or ``split``, whichever is less work."""
    total = int(sizes.sum())
    if total <= _PICK_READS and np.minimum(takes, total - takes).sum() <= 16 * len(sizes) * len(takes):
        return pick(sizes, takes, rng)
    draw, cell, k = split(sizes, takes, rng)
    out = np.zeros((len(takes), len(sizes)), np.int64)
    out[draw, cell] = k
    return out


# ---------------------------------------------------------------- the tree over a table


def _leaves(counts: DataFrame, depth: int) -> DataFrame:
    """``(sample, leaf, leaves, key, total, cells)`` of the samples with ``depth`` reads; a leaf's cells are one row."""
    cells = written(counts.where("reads > 0").select("sample", "feature", F.col("reads").cast("long").alias("reads")))
    deep = cells.groupBy("sample").agg(F.sum("reads").alias("_reads"), F.count("*").alias("_cells")).where(F.col("_reads") >= depth)
    deep = checkpointed(deep.select("sample", F.ceil(F.col("_cells") / LEAF_CELLS).cast("int").alias("leaves")))
    leaf = F.pmod(F.xxhash64("feature"), F.col("leaves")).cast("int")
    dealt = cells.join(broadcast_if_small(deep, deep.count(), 64), "sample").withColumn("leaf", leaf)
    return written(
        dealt.groupBy("sample", "leaf", "leaves")
        .agg(F.sum("reads").alias("total"), F.array_sort(F.collect_list(F.struct("feature", "reads"))).alias("cells"))
        .withColumn("key", F.xxhash64("sample", "leaf"))
    )


def _shares(leaves: DataFrame, depth: int, iters: int, seed: int) -> DataFrame:
    """``leaves`` with ``takes``: the reads each draw has of the leaf; null where the leaf is the whole sample.

    A task gets the totals of a sample's leaves, one row per ``LEAF_CELLS`` cells.
    """
    many = leaves.where("leaves > 1").groupBy("sample").agg(
        F.array_sort(F.collect_list(F.struct("leaf", "total"))).alias("parts"), F.xxhash64("sample").alias("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = b.column(1)[i].values
                leaf, total = parts.field("leaf"), parts.field("total").to_numpy()
                rng = np.random.default_rng([seed, b.column(2)[i].as_py() & (2**64 - 1)])
                draw, cell, k = split(total, np.full(iters, depth), rng)
                takes = np.zeros((len(total), iters), np.int64)
                takes[cell, draw] = k
                at = pa.array(np.arange(len(total) + 1, dtype=np.int32) * iters)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] * len(total))), leaf, pa.ListArray.from_arrays(at, pa.array(takes.ravel()))],
                    names=["sample", "leaf", "takes"],
                )

    schema = leaves.select("sample", "leaf").withColumn("takes", F.array().cast("array<long>")).schema
    return leaves.join(many.mapInArrow(run, schema), ["sample", "leaf"], "left")


def _per_leaf(leaves: DataFrame, depth: int, iters: int, seed: int, emit, schema: T.StructType) -> DataFrame:
    """What ``emit(sample, features, reads, blocks)`` yields for every leaf; a block has its first draw and its numbers."""
    shared = _shares(leaves, depth, iters, seed).select("sample", "cells", "takes", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cells = b.column(1)[i].values
                reads = cells.field("reads").to_numpy()
                takes = b.column(2)[i].values
                takes = np.full(iters, depth) if takes is None else takes.to_numpy()
                rng = np.random.default_rng([seed, b.column(3)[i].as_py() & (2**64 - 1), 1])
                sample = b.column(0).slice(i, 1)
                yield from emit(sample, cells.field("feature"), reads, _blocks(reads, takes, rng))

    return shared.repartition(_width(shared), "key").mapInArrow(run, schema)


def _width(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _blocks(reads: np.ndarray, takes: np.ndarray, rng: np.random.Generator):
    """``(first draw, numbers)`` of each block of draws, the numbers as draws x cells."""
    for first in range(0, len(takes), BLOCK_ITERS):
        yield first, numbers(reads, takes[first : first + BLOCK_ITERS], rng)


def _again(sample: pa.Array, n: int) -> pa.Array:
    return sample.take(pa.array(np.zeros(n, np.int64)))


def rarefy(counts: DataFrame, depth: int, iters: int = 1, seed: int = 1) -> DataFrame:
    """``(iter, sample, feature, reads)`` of ``iters`` draws of ``depth`` reads a sample; shallower samples drop."""
    kinds = {c: counts.schema[c].dataType for c in ("sample", "feature")}
    schema = T.StructType([
        T.StructField("iter", T.IntegerType()), T.StructField("sample", kinds["sample"]),
        T.StructField("feature", kinds["feature"]), T.StructField("reads", T.LongType()),
    ])

    def emit(sample, features, reads, blocks):
        for first, k in blocks:
            draw, cell = np.nonzero(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first + draw).astype(np.int32)), _again(sample, len(draw)), features.take(pa.array(cell)),
                 pa.array(k[draw, cell])],
                names=schema.names,
            )

    return _per_leaf(_leaves(counts, depth), depth, iters, seed, emit, schema)


_HASHED = 1 << 13  # reads whose keys are made at a time
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]


def _md5(words: np.ndarray) -> list[np.ndarray]:
    """The four integers of the md5 of messages of one block each; ``words`` has a row for each of the block's 16 words."""
    some = words.any(axis=1)
    first = [np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in first)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        at = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        a += f
        a += np.uint32(_SINES[i])
        if some[at]:
            a += words[at]
        turn = _TURNS[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=f)
        np.right_shift(a, np.uint32(32 - turn), out=g)
        f |= g
        f += b
        a[:] = f  # the oldest of the four is replaced
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(first, (a, b, c, d))]


def _read_keys(names: list[bytes], reads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(cell, high, low)`` of the reads of cells, some at a time: the halves of the md5 of ``name`` and the read's number."""
    before = np.concatenate([[0], np.cumsum(reads)])
    lengths = np.array([len(n) for n in names], np.int64)
    width = max(64, int(lengths.max(initial=0)))
    table = np.zeros((len(names), width), np.uint8)
    for row, n in zip(table, names):
        row[: len(n)] = np.frombuffer(n, np.uint8)
    for at in range(0, int(before[-1]), _HASHED):
        read = np.arange(at, min(at + _HASHED, int(before[-1])))
        cell = np.searchsorted(before, read, side="right") - 1
        number, size = read - before[cell] + 1, lengths[cell]
        digits = len(str(int(number.max())))
        if size.max() + digits > 55:  # over one block
            whole = [hashlib.md5(names[c] + str(n).encode()).digest() for c, n in zip(cell.tolist(), number.tolist())]
            both = np.frombuffer(b"".join(whole), ">u8").reshape(-1, 2).astype(np.uint64)
            yield cell, both[:, 0], both[:, 1]
            continue
        text = table[cell, :64]
        many, place = np.ones(len(read), np.int64), np.arange(len(read)) * 64 + size
        for d in range(1, digits):
            many += number >= 10**d
        flat = text.reshape(-1)
        for d in range(digits):
            own = np.flatnonzero(many > d) if d else slice(None)
            flat[place[own] + many[own] - 1 - d] = 48 + number[own] // 10**d % 10
        flat[place + many] = 0x80
        words = np.ascontiguousarray(text.view("<u4").T)
        words[14] = (size + many) * 8
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in _md5(words))
        yield cell, (a << np.uint64(32)) | b, (c << np.uint64(32)) | d


#: Standard deviations by which the reads looked at for a keyed draw exceed its depth.
_MARGIN = 12


def _smallest(names: list[bytes], reads: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cell, high, low)`` of the ``depth`` reads with the smallest keys, or of all.

    Keys above one that enough are sure to lie below are not kept; if too few do, all reads are taken again.
    """
    total = int(reads.sum())
    share = (depth + _MARGIN * math.sqrt(depth)) / total
    for bound in ([share] if 0 < share < 1 else []) + [1]:
        kept, held = [], 0
        for cell, high, low in _read_keys(names, reads):
            if bound < 1:
                own = high < np.uint64(int(bound * 2**64))
                cell, high, low = cell[own], high[own], low[own]
            kept.append((cell, high, low))
            held += len(cell)
            if held > max(8 * depth, 1 << 18):
                kept = [_first(kept, depth)]
                held = len(kept[0][0])
        found = _first(kept, depth)
        if len(found[0]) == min(depth, total):
            break
    return found


def _first(parts: list[tuple], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, high, low = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((low, high))[:depth]  # stable, so equal keys are in the order of cells
    return cell[order], high[order], low[order]


def _named(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.coalesce(c["feature"].cast("string"), F.lit("")))


def _names(seed: int, i: int, sample: str, features: list[str]) -> list[bytes]:
    return [f"{seed}-{i}-{sample}-{f}-".encode() for f in features]


def keyed_draws(counts: DataFrame, depth: int, iters: int, seed: int) -> DataFrame:
    """``(iter, sample, feature, reads)`` of draws that any engine can repeat; shallower samples drop.

    A draw has the ``depth`` reads of a sample with the smallest md5 of ``seed-iter-sample-feature-number``. Keys are made and
    compared where the cells are; only a sample of several leaves has the smallest ones of each moved.
    """
    kinds = {c: counts.schema[c].dataType for c in ("sample", "feature")}
    schema = T.StructType([
        T.StructField("iter", T.IntegerType()), T.StructField("sample", kinds["sample"]),
        T.StructField("feature", kinds["feature"]), T.StructField("key", T.BinaryType()), T.StructField("reads", T.LongType()),
    ])

    def drawn(listed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    cells, name = b.column("cells")[r].values, b.column("name")[r].as_py()
                    features, texts = cells.field("feature"), b.column("texts")[r].as_py()
                    reads = cells.field("reads").to_numpy()
                    for i in range(iters):
                        cell, high, low = _smallest(_names(seed, i, name, texts), reads, depth)
                        if listed:
                            keys = np.stack([high, low], axis=1).astype(">u8").view("V16").ravel()
                            key, n = pa.array([k.tobytes() for k in keys], pa.binary()), np.ones(len(cell), np.int64)
                        else:
                            n = np.bincount(cell, minlength=len(reads))
                            cell = np.flatnonzero(n)
                            key, n = pa.nulls(len(cell), pa.binary()), n[cell]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(cell), i, np.int32)), _again(b.column("sample").slice(r, 1), len(cell)),
                             features.take(pa.array(cell)), key, pa.array(n)], names=schema.names,
                        )

        return run

    leaves = _leaves(counts, depth).withColumn("texts", _named(F.col("cells"))).withColumn("name", F.col("sample").cast("string"))
    part = lambda which, listed: (
        leaves.where(which).select("sample", "name", "cells", "texts", "key").repartition(_width(counts), "key").mapInArrow(drawn(listed), schema)
    )
    order = Window.partitionBy("iter", "sample").orderBy("key", "feature")
    several = part("leaves > 1", True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    return part("leaves = 1", False).drop("key").unionByName(
        several.groupBy("iter", "sample", "feature").agg(F.sum("reads").alias("reads"))
    )


#: Reads of a sample up to which its whole order is made in one task.
_ORDERED = 1 << 21


def keyed_curve(counts: DataFrame, step: int, iters: int, seed: int) -> DataFrame:
    """``(sample, depth, features)``: features among the first ``depth`` reads, the mean over ``iters`` orders any engine can repeat.

    Reads are ordered by the md5 of ``seed-iter-sample-feature-number``; depths are every ``step`` reads and all of them. All
    reads are ordered, a sample in its task, from its cells. Those of a sample of over ``_ORDERED`` reads are rows, dealt by ranges of keys.
    """
    cells = written(counts.where("reads > 0").select("sample", "feature", F.col("reads").cast("long").alias("reads")))
    totals = checkpointed(cells.where("sample IS NOT NULL").groupBy("sample").agg(F.sum("reads").alias("total")))
    schema = T.StructType([
        T.StructField("sample", counts.schema["sample"].dataType), T.StructField("depth", T.LongType()), T.StructField("features", T.DoubleType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                reads, texts = b.column("cells")[r].values.field("reads").to_numpy(), b.column("texts")[r].as_py()
                total = int(reads.sum())
                depths = np.unique(np.append(np.arange(step, total + 1, step), total))
                found = np.zeros(len(depths))
                of = np.repeat(np.arange(len(reads)), reads)
                for i in range(iters):
                    parts = [x[1:] for x in _read_keys(_names(seed, i, b.column("name")[r].as_py(), texts), reads)]
                    high, low = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(high, kind="stable")
                    if (np.diff(high[order]) == 0).any():
                        order = np.lexsort((low, high))
                    first = np.empty(len(reads), np.int64)
                    first[of[order][::-1]] = np.arange(total, 0, -1)  # the earliest is written last
                    found += np.searchsorted(np.sort(first), depths, side="right")
                yield pa.RecordBatch.from_arrays(
                    [_again(b.column("sample").slice(r, 1), len(depths)), pa.array(depths), pa.array(found / iters)], names=schema.names
                )

    side = lambda which: broadcast_if_small(totals.where(which), totals.count(), 64)
    whole = (
        cells.join(side(F.col("total") <= _ORDERED), "sample").repartition(_width(counts), "sample")
        .groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("feature", "reads"))).alias("cells"))
        .select("sample", F.col("sample").cast("string").alias("name"), "cells", _named(F.col("cells")).alias("texts"))
        .mapInArrow(run, schema)
    )
    if not totals.where(F.col("total") > _ORDERED).take(1):
        return whole
    # a range of keys has some _ORDERED reads
    ranges = F.floor(F.col("total") / _ORDERED) + 1
    name = F.concat_ws("-", F.lit(seed), "iter", "sample", F.coalesce(F.col("feature").cast("string"), F.lit("")), "i")
    rows = (
        cells.join(side(F.col("total") > _ORDERED), "sample")
        .withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1)))).repartition(_width(counts), "sample", "feature", "iter")
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "reads"))).withColumn("key", F.md5(name))
        .withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / 2**32))
        .withColumn("rank", F.row_number().over(Window.partitionBy("iter", "sample", "part").orderBy("key", "feature", "i")))
    )
    ranked = checkpointed(rows.groupBy("iter", "sample", "part", "feature").agg(F.min("rank").alias("rank")))
    sizes = rows.groupBy("iter", "sample", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("iter", "sample").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("iter", "sample", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    firsts = ranked.join(before, ["iter", "sample", "part"]).groupBy("iter", "sample", "feature").agg(F.min(F.col("rank") + F.col("before")).alias("first"))
    new = (
        firsts.join(totals, "sample").withColumn("depth", F.least(F.ceil(F.col("first") / step) * step, F.col("total")))
        .groupBy("sample", "depth").agg(F.count("*").alias("new"))
    )
    grid = totals.where(F.col("total") > _ORDERED).select("sample", F.explode(_grid(step)).alias("depth"))
    seen = grid.join(new, ["sample", "depth"], "left")
    many = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("sample").orderBy("depth"))
    return whole.unionByName(seen.select("sample", "depth", (many / iters).alias("features")))


def drawn_moments(counts: DataFrame, depth: int, iters: int, seed: int = 1) -> DataFrame:
    """``(sample, feature, reads, mean, variance)``: of the drawn number over all draws, for every cell of a deep sample."""
    kinds = {c: counts.schema[c].dataType for c in ("sample", "feature")}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in kinds] + [T.StructField("reads", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("mean", "variance")]
    )

    def emit(sample, features, reads, blocks):
        one, two = np.zeros(len(reads)), np.zeros(len(reads))
        for _, k in blocks:
            one += k.sum(axis=0)
            two += np.einsum("dc,dc->c", k, k)
        mean = one / iters
        var = (two - iters * mean * mean) / max(iters - 1, 1)
        yield pa.RecordBatch.from_arrays(
            [_again(sample, len(reads)), features, pa.array(reads), pa.array(mean), pa.array(var)], names=schema.names
        )

    return _per_leaf(_leaves(counts, depth), depth, iters, seed, emit, schema)


MEASURES = ("coverage", "invsimpson", "shannon", "sobs")


def drawn_alpha(counts: DataFrame, depth: int, iters: int, seed: int = 1) -> DataFrame:
    """``(sample, iter, coverage, invsimpson, shannon, sobs)`` of every draw.

    A leaf gives four sums a draw, which add up over the leaves of a sample; drawn cells are not listed. Sums of a
    sample of one leaf are not moved.
    """
    sums = ("sobs", "single", "pairs", "nlogn")
    schema = T.StructType(
        [T.StructField("sample", counts.schema["sample"].dataType), T.StructField("iter", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in sums]
    )

    logs = np.arange(min(depth, 1 << 16) + 1, dtype=float)
    logs[1:] *= np.log(logs[1:])

    def emit(sample, features, reads, blocks):
        found = []
        for _, k in blocks:
            nlogn = logs[k] if k.max(initial=0) < len(logs) else k * np.log(np.maximum(k, 1))
            found.append([(k > 0).sum(axis=1), (k == 1).sum(axis=1), (k.astype(float) * (k - 1)).sum(axis=1), nlogn.sum(axis=1)])
        columns = [pa.array(np.concatenate(p).astype(float)) for p in zip(*found)]
        yield pa.RecordBatch.from_arrays([_again(sample, iters), pa.array(np.arange(iters, dtype=np.int32)), *columns], names=schema.names)

    leaves = _leaves(counts, depth)
    part = lambda which: _per_leaf(leaves.where(which), depth, iters, seed, emit, schema)
    total = part("leaves = 1").unionByName(
        part("leaves > 1").groupBy("sample", "iter").agg(*[F.sum(c).alias(c) for c in sums])
    )
    m = float(depth)
    return total.select(
        "sample", "iter", (1 - F.col("single") / m).alias("coverage"),
        F.when(F.col("pairs") > 0, m * (m - 1) / F.col("pairs")).alias("invsimpson"),
        (F.log(F.lit(m)) - F.col("nlogn") / m).alias("shannon"), "sobs",
    )


def alpha_subsampled(counts: DataFrame, depth: int, iters: int, seed: int = 1) -> DataFrame:
    """Mean (``ave``) and standard deviation (``std``) of the indices over equal-depth draws."""
    wide = drawn_alpha(counts, depth, iters, seed).groupBy("sample").agg(
        *[f(m).alias(f"{m}_{s}") for m in MEASURES for s, f in (("ave", F.avg), ("std", F.stddev_samp))]
    )
    rows = F.array(
        *[F.struct(F.lit(s).alias("method"), *[F.col(f"{m}_{s}").alias(m) for m in MEASURES]) for s in ("ave", "std")]
    )
    return wide.select("sample", F.inline(rows))


# ---------------------------------------------------------------- expectations over all draws


def _missed(total: Column, n: Column, depth: Column) -> Column:
    """Probability that none of the ``n`` reads of a cell is among ``depth`` of ``total``."""
    p = F.exp(log_falling(total - depth, n) - log_falling(total, n))
    return F.when(n > total - depth, F.lit(0.0)).otherwise(p)


def _hits(total: Column, n: Column, depth: Column, k: Column) -> Column:
    """Probability that exactly ``k`` of the ``n`` reads are among ``depth`` of ``total``."""
    p = F.exp(
        log_falling(n, k) - log_factorial(k) + log_falling(depth, k) + log_falling(total - depth, n - k) - log_falling(total, n)
    )
    return F.when((k > n) | (k > depth) | (n - k > total - depth), F.lit(0.0)).otherwise(p)


def _sizes(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of each size by sample, ``(sample, n, cells)``, and the reads per sample; both written."""
    sizes = checkpointed(counts.where("reads > 0").groupBy("sample", F.col("reads").cast("long").alias("n")).agg(F.count("*").alias("cells")))
    return sizes, checkpointed(sizes.groupBy("sample").agg(F.sum(F.col("n") * F.col("cells")).alias("total")))


def _grid(step: int) -> Column:
    """Every ``step`` reads up to ``total``, and ``total``."""
    by_step = F.sequence(F.lit(step).cast("long"), "total", F.lit(step).cast("long"))
    return F.array_union(F.when(F.col("total") >= step, by_step).otherwise(F.array().cast("array<bigint>")), F.array("total"))


def expected_curve(counts: DataFrame, step: int = 100) -> DataFrame:
    """``(sample, depth, features)``: the expected number of features at every ``step`` reads and at all of them.

    The mean of the accumulation curve over all orders of the reads. Cells of equal size are one row, so the work is
    sizes x depths, whatever the number of features.
    """
    sizes, totals = _sizes(counts)
    small = broadcast_if_small(totals, totals.count(), 64)
    rows = sizes.join(small, "sample").withColumn("depth", F.explode(_grid(step)))
    seen = F.col("cells") * (1 - _missed(F.col("total"), F.col("n"), F.col("depth")))
    return rows.groupBy("sample", "depth").agg(F.sum(seen).alias("features"))


def expected_alpha(counts: DataFrame, depth: int) -> DataFrame:
    """``(sample, coverage, shannon, sobs)``: expectations over all draws of ``depth`` reads; shallower samples drop."""
    sizes, totals = _sizes(counts)
    deep = totals.where(F.col("total") >= depth)
    rows = sizes.join(broadcast_if_small(deep, totals.count(), 64), "sample")
    total, n, m = F.col("total"), F.col("n"), F.lit(depth).cast("long")
    some = F.sequence(F.lit(2).cast("long"), F.greatest(F.least(n, m), F.lit(2)))
    entropy = F.aggregate(some, F.lit(0.0), lambda a, k: a + _hits(total, n, m, k) * k * F.log(k))
    cells = F.col("cells")
    return rows.groupBy("sample").agg(
        (1 - F.sum(cells * _hits(total, n, m, F.lit(1).cast("long"))) / depth).alias("coverage"),
        (F.log(F.lit(float(depth))) - F.sum(cells * entropy) / depth).alias("shannon"),
        F.sum(cells * (1 - _missed(total, n, m))).alias("sobs"),
    )


def expected_moments(counts: DataFrame, depth: int) -> DataFrame:
    """``(sample, feature, reads, expected, variance)`` of the number drawn from every cell of a sample of that depth."""
    _, totals = _sizes(counts)
    deep = totals.where(F.col("total") >= depth)
    cells = counts.where("reads > 0").join(broadcast_if_small(deep, totals.count(), 64), "sample")
    share = F.col("reads") / F.col("total")
    rest = F.when(F.col("total") > 1, (F.col("total") - depth) / (F.col("total") - 1)).otherwise(0.0)
    return cells.select(
        "sample", "feature", F.col("reads").cast("long").alias("reads"), (depth * share).alias("expected"),
        (depth * share * (1 - share) * rest).alias("variance"),
    )


def expected_beta(counts: DataFrame, depth: int, block_size: int = 2048) -> DataFrame:
    """``(a, b, dist)``: the mean Bray-Curtis distance of two samples over all draws of ``depth`` reads each.

    With equal depths the distance is one less the shared reads over the depth. The draws of two samples are
    independent, so the expected minimum of two counts is the sum over ``t`` of the products of their chances to reach
    ``t``: one matrix product over (feature, t), done in blocks of samples.
    """
    cells = written(counts.where("reads > 0").select("sample", "feature", F.col("reads").cast("long").alias("reads")))
    sizes, totals = _sizes(cells)
    deep = checkpointed(totals.where(F.col("total") >= depth))
    total, n, m = F.col("total"), F.col("n"), F.lit(depth).cast("long")
    last = F.least(n, m)
    exactly = F.transform(F.sequence(F.lit(1).cast("long"), last), lambda k: _hits(total, n, m, k))
    # from the far end, so that small chances are added first
    tail = F.aggregate(F.reverse("exactly"), F.array().cast("array<double>"), lambda a, p: F.concat(
        F.array(p + F.when(F.size(a) > 0, F.element_at(a, F.lit(1))).otherwise(0.0)), a))
    # cells of equal size in a sample have the same chances
    width = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # small rows, but much work on them
    rows = sizes.join(broadcast_if_small(deep, totals.count(), 64), "sample").repartition(width, "sample", "n")
    reach = rows.withColumn("exactly", exactly).select("sample", F.col("n").alias("x"), "cells", tail.alias("values"))
    # chances too small to count in a double end the list
    reach = written(reach.withColumn("values", F.filter("values", lambda p: p > 1e-18)))
    cells = cells.join(broadcast_if_small(deep.select("sample"), totals.count(), 48), "sample")
    return block_products(cells.select("sample", "feature", F.col("reads").alias("x")), reach, block_size).select("a", "b", (1 - F.col("shared") / depth).alias("dist"))
