"""Pairs of equal-length strings with few mismatches, through blocking that fits the columns of each length.

The positions of a length are dealt to ``d + r`` segments. Two strings within ``d`` mismatches agree on at least ``r`` of
them whatever the dealing, so they share one of the keys made of ``r`` segments each. The dealing follows the
columns: positions are ordered by how much they vary in a sample and dealt in turn, so variable columns are in all
segments, and a family that varies in one region has no segment of conserved positions alone. ``r`` is the number
with the least work in the sample. Sample, order and ``r`` only balance the work; any give the same pairs.

A length whose texts fit a task is done there: its texts are moved once, keys and candidates stay in the task. Only the keys
of longer lists, and of those with very many candidates, are moved as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_BYTES, checkpointed

SAMPLE = 512  # strings of a length that its columns are judged by, and their characters at most
SAMPLE_CHARS = 1 << 22
MOST_KEYS = 64  # keys of a string, where more than one segment a key is chosen
GROUP_CHARS = 1 << 24  # characters of a length, and its texts, up to which one task has them all
GROUP_ROWS = 200_000
GROUP_PAIRS = 1 << 26  # candidates of a length beyond which its keys are dealt to tasks
DIRECT = 256  # texts of a length up to which all are compared
CELLS = 1 << 22  # characters or keys of pairs that are compared at a time
HOT = 2_000  # members of a key that one task pairs; more are dealt to blocks, and every pair of blocks is a key


def code_points(texts: list[str]) -> np.ndarray:
    """The characters of all texts, one number each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _segments(chars: np.ndarray, order: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash per row of ``chars`` and segment; the ``i``-th position of ``order`` is in segment ``i % m``."""
    if m == 0 or chars.shape[1] == 0:
        return np.zeros((len(chars), 1), np.uint64)
    rng = np.random.default_rng(chars.shape[1])
    factor = rng.integers(1, 1 << 63, chars.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    by_segment = np.argsort(np.arange(len(order)) % m, kind="stable")
    columns = order[by_segment]
    starts = np.concatenate([[0], np.cumsum(np.bincount(np.arange(len(order)) % m, minlength=m))[:-1]])
    weighted = (chars[:, columns].astype(np.uint64) + np.uint64(1)) * factor[columns]
    return np.add.reduceat(weighted, starts, axis=1)


def _keys(segments: np.ndarray, r: int) -> np.ndarray:
    """One key per row and choice of ``r`` segments."""
    out = []
    for k, some in enumerate(combinations(range(segments.shape[1]), r)):
        key = np.full(len(segments), k + 1, np.uint64)
        for s in some:
            key = (key ^ segments[:, s]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.stack(out, axis=1)


def choose(chars: np.ndarray, d: int, rows: int) -> tuple[int, int, np.ndarray]:
    """Segments, segments of a key, and order of positions, for ``rows`` strings of which ``chars`` is a sample."""
    n, length = chars.shape
    if length <= d:  # all match
        return 0, 1, np.arange(length)
    ordered = np.sort(chars, axis=0)
    alike = (ordered[1:] == ordered[:-1]).sum(axis=0)  # the fewer characters a column has, the more
    order = np.argsort(alike, kind="stable")
    best = None
    for r in range(1, min(8, length - d) + 1):
        m = d + r
        if r > 1 and comb(m, r) > MOST_KEYS:
            break
        keys = _keys(_segments(chars, order, m), r)
        pairs = 0.0
        for k in range(keys.shape[1]):
            _, c = np.unique(keys[:, k], return_counts=True)
            pairs += (c * (c - 1.0)).sum() / 2
        work = rows * keys.shape[1] + 3 * pairs * (rows / n) ** 2
        if best is None or work < best[0]:
            best = (work, m, r)
    return best[1], best[2], order


def _plan(part: pd.DataFrame) -> pd.DataFrame:
    chars = code_points(part["seq"].tolist()).reshape(len(part), -1)
    m, r, order = choose(chars, int(part["d"].iloc[0]), int(part["rows"].iloc[0]))
    return pd.DataFrame({"len": part["len"].iloc[:1], "m": [m], "r": [r], "order": [order.astype(np.int32)]})


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            length, m, r = (b.column(i).to_numpy() for i in (2, 3, 4))
            texts = b.column(1).to_pylist()
            cuts = np.flatnonzero(np.diff(length)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(length)]):
                chars = code_points(texts[s:e]).reshape(e - s, -1)
                order = b.column(5)[s].values.to_numpy()
                keys = _keys(_segments(chars, order, int(m[s])), int(r[s]))
                keys ^= length[s : s + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                who = b.column(0).take(pa.array(np.repeat(np.arange(s, e), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([who, pa.array(keys.ravel().view(np.int64))], names=["seq_id", "key"])


def _count(df: DataFrame, entries: Column) -> tuple[int, int]:
    row = df.agg(F.count("*"), F.sum(entries)).first()
    return row[0], row[1] or 0


def candidates(base: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``, ``a < b``, of ``base(seq_id, seq, len, d)`` that share a key; ``base`` is written.

    ``d`` follows from ``len``. All pairs within ``d`` mismatches are among them.
    """
    lens = checkpointed(base.groupBy("len").agg(F.count("*").alias("rows")))
    count, chars = _count(lens, F.col("len").cast("long"))
    hint = F.broadcast if 64 * count <= BROADCAST_BYTES else (lambda x: x)
    # the more strings of a length there are, the rarer the chance agreements that still matter
    enough = F.least(F.lit(SAMPLE), F.ceil(4 * F.sqrt("rows")))
    want = F.greatest(F.lit(2), F.least(enough, F.floor(F.lit(SAMPLE_CHARS) / F.greatest(F.col("len"), F.lit(1)))))
    some = F.pmod(F.xxhash64("seq_id"), F.greatest(F.floor(F.col("rows") / want), F.lit(1))) == 0
    # a sample of which at least one row is there for every length
    first = base.groupBy("len").agg(F.min_by(F.struct("seq", "d"), "seq_id").alias("x")).select("len", "x.*")
    sample = base.join(hint(lens), "len").where(some).select("len", "seq", "d").unionByName(first)
    width = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # small rows, but much work on them
    sized = sample.join(hint(lens), "len").select("len", "seq", "d", "rows").repartition(width, "len")
    plan = checkpointed(sized.groupBy("len").applyInPandas(_plan, "len int, m int, r int, order array<int>"))
    small = F.broadcast(plan) if 64 * count + 8 * chars <= BROADCAST_BYTES else plan
    kind = base.schema["seq_id"].dataType
    schema = T.StructType([T.StructField("seq_id", kind), T.StructField("key", T.LongType())])
    laid = base.join(small, "len").select("seq_id", "seq", "len", "m", "r", "order").sortWithinPartitions("len")
    keyed = laid.mapInArrow(_key_rows, schema)  # made twice, as it is cheaper to make than to store
    shared = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    left = keyed.join(F.broadcast(shared) if 32 * shared.count() <= BROADCAST_BYTES else shared, "key")
    blocks = F.when(F.col("n") > HOT, F.ceil(2 * F.col("n") / HOT)).otherwise(1).cast("int")
    left = left.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("seq_id", "key"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR own <> other")
    left = checkpointed(left.select("seq_id", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    a, b = left.withColumnRenamed("seq_id", "a"), left.withColumnRenamed("seq_id", "b")
    return a.join(b, ["key", "i", "j"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            length = b.column(4).to_numpy().astype(np.int64)
            differ = code_points(b.column(2).to_pylist()) != code_points(b.column(3).to_pylist())
            before = np.concatenate([[0], np.cumsum(differ)])
            ends = np.cumsum(length)
            diffs = (before[ends] - before[ends - length]).astype(np.int32)
            keep = pa.array(diffs <= b.column(5).to_numpy())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(diffs), b.column(4)], names=["a", "b", "diffs", "len"])
            yield out.filter(keep)


def _compared(chars: np.ndarray, d: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, chars.shape[1]))
    for at in range(0, len(x), step):
        i, j = x[at : at + step], y[at : at + step]
        diffs = (chars[i] != chars[j]).sum(axis=1)
        near = diffs <= d
        yield i[near], j[near], diffs[near]


def _together(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the end of its run of equal values."""
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered))
    return np.repeat(ends, np.diff(ends, prepend=0))


def pairs_of_length(chars: np.ndarray, d: int, direct: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """``(x, y, diffs)`` of the rows of ``chars`` within ``d`` mismatches, each pair once; None if it has too many candidates."""
    n, length = chars.shape
    if n <= direct:
        i, j = np.triu_indices(n, 1)
        return _compared(chars, d, i, j)
    want = max(2, min(SAMPLE, 4 * int(n**0.5) + 1, SAMPLE_CHARS // max(1, length)))
    m, r, order = choose(chars[:: max(1, n // want)][:want], d, n)
    step = max(1, CELLS // max(1, length))
    keys = np.concatenate([_keys(_segments(chars[at : at + step], order, m), r) for at in range(0, n, step)])
    places = np.arange(n)
    if sum(int((_together(np.sort(keys[:, k])) - places - 1).sum()) for k in range(keys.shape[1])) > most:
        return None

    def run() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(keys.shape[1]):
            row = np.argsort(keys[:, k], kind="stable")
            ends, at, far = _together(keys[row, k]), places, 0
            while True:
                far += 1
                at = at[at + far < ends[at]]
                if not len(at):
                    break
                x, y = row[at], row[at + far]
                for s in range(0, k, 16):  # a pair that shares an earlier key has been compared
                    new = (keys[x, s : min(k, s + 16)] != keys[y, s : min(k, s + 16)]).all(axis=1)
                    x, y = x[new], y[new]
                    if not len(x):
                        break
                yield from _compared(chars, d, x, y)

    return run()


def _near_rows(held: list[pa.RecordBatch], limits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The near pairs of the texts of one length, or a row of -1 mismatches if its keys are to be dealt."""
    whole = pa.Table.from_batches(held).combine_chunks()
    ids, length, d = whole.column(0).combine_chunks(), whole.column(2)[0].as_py(), whole.column(3)[0].as_py()
    chars = code_points(whole.column(1).to_pylist()).reshape(len(ids), length)
    top = int(chars.max(initial=0))
    chars = chars.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)

    def rows(x: np.ndarray, y: np.ndarray, diffs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(diffs.astype(np.int32)), pa.array(np.full(len(x), length, np.int32))],
            names=["a", "b", "diffs", "len"],
        )

    found = pairs_of_length(chars, d, *limits)
    if found is None:
        yield rows(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1))
        return
    some, count = [], 0
    for part in found:
        some.append(part)
        count += len(part[0])
        if count >= 20_000 or len(some) >= 1_000:
            yield rows(*(np.concatenate(c) for c in zip(*some)))
            some, count = [], 0
    if count:
        yield rows(*(np.concatenate(c) for c in zip(*some)))


def _near_of_lengths(*limits: int):
    """Pairs of the texts of each length; the rows come sorted by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            length = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(length)) + 1).tolist(), len(length)]
            for s, e in zip(cuts, cuts[1:]):
                if s < e and length[s] != now:
                    if held:
                        yield from _near_rows(held, limits)
                    held, now = [], length[s]
                if s < e:
                    held.append(b.slice(s, e - s))
        if held:
            yield from _near_rows(held, limits)

    return run


def near_pairs(seqs: DataFrame, allowed: Callable[[Column], Column]) -> DataFrame:
    """``(a, b, diffs, len)`` of equal-length distinct sequences differing in at most ``allowed(length)`` positions; written."""
    base = seqs.select("seq_id", "seq", F.length("seq").alias("len"))
    # a length that occurs once has no partner
    fits = (F.col("rows") * F.col("len") <= GROUP_CHARS) & (F.col("rows") <= GROUP_ROWS)
    lens = checkpointed(base.groupBy("len").agg(F.count("*").alias("rows")).where("rows > 1").select("len", "rows", fits.alias("fits")))
    count, chars = _count(lens, F.when(F.col("fits"), F.col("rows") * F.col("len")))
    hint = F.broadcast if 32 * count <= BROADCAST_BYTES else (lambda x: x)
    width = max(1, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = max(width, -(-chars // GROUP_CHARS))

    def of(some: DataFrame) -> DataFrame:
        return base.join(hint(some.select("len")), "len", "left_semi").select(
            "seq_id", "seq", "len", allowed(F.col("len")).cast("int").alias("d")
        )

    kind = seqs.schema["seq_id"].dataType
    schema = T.StructType([
        T.StructField("a", kind), T.StructField("b", kind), T.StructField("diffs", T.IntegerType()), T.StructField("len", T.IntegerType())
    ])
    laid = of(lens.where("fits")).repartition(parts, "len").sortWithinPartitions("len")
    first = F.col("a") < F.col("b")
    low, high = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    found = checkpointed(laid.mapInArrow(_near_of_lengths(DIRECT, GROUP_PAIRS), schema).select(low.alias("a"), high.alias("b"), "diffs", "len"))
    rest = checkpointed(lens.where("NOT fits").select("len").unionByName(found.where("diffs < 0").select("len")))
    if not rest.take(1):
        return found
    return found.where("diffs >= 0").unionByName(checkpointed(_near_by_keys(of(rest), width, schema)))


def _near_by_keys(base: DataFrame, width: int, schema: T.StructType) -> DataFrame:
    """Near pairs of lengths whose texts are spread over tasks; ``base(seq_id, seq, len, d)``."""
    base = checkpointed(base.repartition(width, "seq_id").withColumn("row", F.monotonically_increasing_id()))  # a short name, written with the row
    found = checkpointed(candidates(base.select(F.col("row").alias("seq_id"), "seq", "len", "d")))
    ends = checkpointed(found.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    # other texts are not moved
    some = base.join(F.broadcast(ends) if 16 * ends.count() <= BROADCAST_BYTES else ends, "row", "left_semi")
    side = lambda x: some.select(F.col("row").alias(x), F.struct("seq_id", "seq").alias(f"s{x}"), F.col("len").alias(f"l{x}"), "d")
    pairs = found.join(side("a"), "a").join(side("b").drop("d"), "b").where("la = lb")
    first = F.col("sa.seq_id") < F.col("sb.seq_id")
    low, high = F.when(first, F.col("sa")).otherwise(F.col("sb")), F.when(first, F.col("sb")).otherwise(F.col("sa"))
    pairs = pairs.select(low.alias("x"), high.alias("y"), F.col("la").alias("len"), "d")
    pairs = pairs.select(F.col("x.seq_id").alias("a"), F.col("y.seq_id").alias("b"), F.col("x.seq").alias("sa"), F.col("y.seq").alias("sb"), "len", "d")
    return pairs.mapInArrow(_verify, schema)
