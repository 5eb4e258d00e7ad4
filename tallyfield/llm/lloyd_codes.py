"""Vectors as short codes: Lloyd rounds per part of the vector, where only entries that moved are compared again.

Every vector is stored with its integer components, the entry of each part and the exact distance to it. An
entry that did not change leaves that distance right, so a part assigned to it meets the moved entries alone; a part
whose entry moved meets all. Each pass writes the new state and, beside it, one row of sums per entry that a task
met; a grouped sum over these rows is the next codebook. A lost executor repeats tasks of the current pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import checkpointed, join_hot, remove_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer component; so all distances of a vector and the sums of 2**36 of them fit into 64 bits.
LARGEST = 1 << 26


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of the nearest of all entries, the lower index of equal ones."""
    code, best = np.zeros(len(x), np.uint8), ((x - book[0]) ** 2).sum(1)
    for k in range(1, len(book)):
        d = ((x - book[k]) ** 2).sum(1)
        less = d < best
        code[less], best[less] = k, d[less]
    return code, best


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> int:
    """New ``code`` and ``dist`` in place after the entries in ``moved`` changed; the number of distances computed."""
    again = moved[code]
    still = np.flatnonzero(~again)
    c, best = code[still], dist[still]
    for k in np.flatnonzero(moved):
        d = ((x[still] - book[k]) ** 2).sum(1)
        less = (d < best) | ((d == best) & (k < c))
        c[less], best[less] = k, d[less]
    code[still], dist[still] = c, best
    if again.any():
        code[again], dist[again] = nearest(x[again], book)
    return len(still) * int(moved.sum()) + int(again.sum()) * len(book)


def components(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of all vectors as rows of ``dims`` integers; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}")
    out = np.zeros((len(sizes), dims), np.int64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat.astype(np.int64)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of an array as a column of their bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _pass(books: np.ndarray, moved: np.ndarray | None, scale: int):
    """One pass over the state, or over the vectors if nothing is ``moved`` yet."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, extra = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64), None
        for whole in batches:
            for b in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                extra = b.slice(0, 0)
                n = b.num_rows
                if moved is None:
                    x = components(b.column(2), parts * width, scale)
                    code, dist = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64)
                else:
                    x = _rows(b.column(2), np.int32, parts * width).astype(np.int64)
                    code, dist = _rows(b.column(3), np.uint8, parts).copy(), _rows(b.column(4), np.int64, parts).copy()
                cut = x.reshape(n, parts, width)
                for p in range(parts):
                    if moved is None:
                        code[:, p], dist[:, p] = nearest(cut[:, p], books[p])
                    elif moved[p].any():
                        c, d = code[:, p].copy(), dist[:, p].copy()
                        reassign(cut[:, p], books[p], moved[p], c, d)
                        code[:, p], dist[:, p] = c, d
                    member = code[:, p] == np.arange(entries)[:, None]
                    counts[p] += member.sum(1)
                    sums[p] += member.astype(np.int64) @ cut[:, p]
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), _fixed(x.astype(np.int32)), _fixed(code), _fixed(dist), pa.array(dist.sum(1)), none],
                    names=NAMES,
                )
        if extra is not None:
            p, k = np.nonzero(counts)
            stat = np.concatenate([(p * entries + k)[:, None], counts[p, k][:, None], sums[p, k]], 1).tolist()
            none = [pa.nulls(len(p), t) for t in (extra.column(0).type, extra.column(1).type, *[pa.binary()] * 3, pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(stat, pa.list_(pa.int64()))], names=NAMES)

    return run


NAMES = ["vec_id", "label", "vec", "code", "dist", "error", "stat"]


def _moved_means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks; entries without a part stay. One row per entry reaches the driver."""
    parts, entries, width = books.shape
    stat = [F.sum(F.element_at("stat", i + 2)).alias(f"s{i}") for i in range(width + 1)]
    found = state.where("stat IS NOT NULL").groupBy(F.element_at("stat", 1).alias("entry")).agg(*stat).collect()
    out = books.copy()
    for r in found:
        p, k = divmod(r["entry"], entries)
        out[p, k] = [r[f"s{i + 1}"] // r["s0"] for i in range(width)]  # floor, below zero too
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of every kept row, and the codebooks by part, entry and position.

    ``code`` holds a byte per part, ``error`` the squared distances summed over the parts. Rows are left out if the
    vector is null or holds a null, NaN or infinite component. Vectors shorter than the longest, and a longest one that
    the parts don't divide, count as ended by zeros; an empty vector is all zeros. The starting entries are the rows of
    the smallest ids, null ids last, equal ids by their vectors; with fewer rows there are fewer entries. Repeated rows
    and null ids are coded each. Components beyond ``LARGEST / scale`` raise an error, as their distances overflow.

    The vectors are read twice; each round then reads and writes the state, of which two versions exist at a time.
    Nothing is shuffled but a row of sums per task and entry.
    """
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("a code has one byte per part")
    sound = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(sound).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    first = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = components(pa.array([list(r["vector"]) for r in first], pa.list_(pa.float64())), parts * width, scale)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    schema = kept.select("vec_id", "label").withColumns(
        {c: F.lit(None).cast(t) for c, t in zip(NAMES[2:], ("binary", "binary", "binary", "long", "array<long>"))}
    ).schema
    source, moved, path = kept, None, None
    for r in range(rounds + 1 if first else 0):
        done, path = path, scratch_path(spark, f"codes-{r}")
        source.mapInArrow(_pass(books, moved, scale), schema).write.parquet(path)
        if done:
            remove_path(spark, done)
        state = spark.read.schema(schema).parquet(path)
        if r < rounds:
            new = _moved_means(state, books)
            moved, books = (new != books).any(axis=2), new
            if not moved.any():  # no later round changes anything
                break
        source = state.where("stat IS NULL").select(NAMES[:5])
    if not first:
        state = spark.createDataFrame([], schema)
    return state.where("stat IS NULL").select("vec_id", "label", "code", "error"), books


def label_errors(coded: DataFrame, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of its label; null labels are one label.

    Sums are taken before the shuffle; the few labels that may hold a large share of the rows are broadcast.
    """
    keyed = coded.drop("label_error").withColumn("__key", F.struct(label_col))
    sums = keyed.groupBy("__key").agg(F.sum(error_col).alias("label_error"), F.count("*").alias("__n"))
    return join_hot(keyed, checkpointed(sums), "__key", "__n").drop("__key")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
