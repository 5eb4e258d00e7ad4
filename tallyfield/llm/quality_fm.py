"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The second sum is all pairwise interactions of rank ``RANK`` in time linear in the features that are present.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WORD_BUCKETS = 1 << 15
RANK = 8
#: Cut points of the structure statistics; all of them are shares or are scaled to about 0 to 1.
CUTS = np.array([0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
N_STATS = 18
N_FEATURES = WORD_BUCKETS + N_STATS * (len(CUTS) + 1)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_STOP = b".!?"
_PLAIN = b".,;:'\"()-"


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes, words: list[bytes], tally: Counter) -> list[float]:
    """Structure statistics and length metadata of a text, each about 0 to 1."""
    n, k = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    letters = _count(text, _LETTER)
    digits, spaces = _count(text, _DIGIT), _count(text, _SPACE)
    symbols = len(text) - letters - digits - spaces
    top = max(tally.values(), default=0)
    last = [w[-1] for w in words]
    ends = Counter(last)
    odd_ends = sum(c for b, c in ends.items() if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b or b in _PLAIN or b in _STOP))
    starts_upper = sum(65 <= x[0] < 91 or x[0] >= 128 for x in lines)
    return [
        _count(text, _UPPER) / max(letters, 1),
        digits / n,
        symbols / n,
        (symbols - _count(text, _PLAIN) - _count(text, _STOP)) / n,
        _count(text, _STOP) / k,
        text.count(b",") / k,
        text.count(b"|") / k,
        text.count(b"!") / k,
        odd_ends / k,
        letters / k / 16,
        len(tally) / k,
        top / k,
        sum(a == b for a, b in zip(words, words[1:])) / k,
        1 - len(set(lines)) / m,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
        starts_upper / m,
        np.log1p(k) / 12,
        np.log1p(k / m) / 8,
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(indices, values)``: words by hash, of length 1 together, and one indicator per statistic."""
    words = text.split()
    lowered = Counter(text.lower().split())
    stats = np.searchsorted(CUTS, statistics(text, words, lowered), side="left")
    base = WORD_BUCKETS + np.arange(N_STATS) * (len(CUTS) + 1)
    k = len(lowered)
    index = np.empty(k + N_STATS, np.int32)
    index[:k] = np.fromiter(map(zlib.crc32, lowered), np.uint32, k) % WORD_BUCKETS
    index[k:] = base + stats
    value = np.ones(k + N_STATS, np.float32)
    if k:
        w = 1 + np.log(np.fromiter(lowered.values(), np.float32, k))
        value[:k] = w / np.sqrt((w * w).sum())
    return index, value


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each row, and the factor sums ``sum_i v_if x_i``."""
        vx = self.factor[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.weight[index] * value, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        index, value = (np.concatenate([r[j] for r in rows]) for j in (0, 1))
        return 1 / (1 + np.exp(-self.raw(index, value, starts)[0].astype(np.float64)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 20, batch: int = 128,
        rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Model:
    """Adagrad on the log loss over the given sample, which must be bounded. No rows: a score of one half."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.05, (N_FEATURES, RANK)).astype(np.float32))
    if not len(rows):
        model.factor[:] = 0
        return model
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(share / (1 - share)))
    g_bias, g_weight, g_factor = 1.0, np.full(N_FEATURES, 0.1, np.float32), np.full((N_FEATURES, RANK), 0.1, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            sizes = np.array([len(rows[i][0]) for i in some])
            raw, sums = model.raw(index, value, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            error = (1 / (1 + np.exp(-raw)) - labels[some]) / len(some)
            each = np.repeat(error, sizes) * value
            used, place = np.unique(index, return_inverse=True)
            grad = np.bincount(place, each, len(used)) + decay * model.weight[used]
            g_weight[used] += grad * grad
            model.weight[used] -= rate * grad / np.sqrt(g_weight[used])
            pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - model.factor[index] * value[:, None])
            for f in range(RANK):
                grad = np.bincount(place, pull[:, f], len(used)) + decay * model.factor[used, f]
                g_factor[used, f] += grad * grad
                model.factor[used, f] -= rate * grad / np.sqrt(g_factor[used, f])
            total = error.sum()
            g_bias += total * total
            model.bias -= float(rate * total / np.sqrt(g_bias))
    return model


def held_out(doc_id) -> "F.Column":
    """One row in five by CRC-32 of the id as text; those labels are never learned from. A null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out, those of the smallest id hash.

    The sample is bounded, so its features come to the driver. An id with several labels takes the smallest;
    null labels and ids are left out.
    """
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in utf8(b.column("__text"))]
            yield pa.RecordBatch.from_pydict({
                "id": b.column("__id").cast(pa.int64()), "label": b.column("__label"),
                "i": pa.array([i.tobytes() for i, _ in found], pa.binary()),
                "v": pa.array([v.tobytes() for _, v in found], pa.binary()),
            })

    got = chosen.mapInArrow(rows, "id long, label int, i binary, v binary").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["i"])))
    pairs = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got[:max_rows]]
    return fit(pairs, np.array([r["label"] for r in got[:max_rows]], np.float32))


def score(docs: DataFrame, model: Model, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null text is scored as empty.

    The model has a fixed size of about a megabyte and is broadcast. Repeated rows give repeated results, an
    empty table an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                    "score": pa.array(shared.value.score([features(t) for t in utf8(part.column("text"))]), pa.float64()),
                })

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                        F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )


def keep_good(docs: DataFrame, model: Model, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with their own columns, in one pass and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                good = shared.value.score([features(t) for t in utf8(part.column(text_col))]) >= cut
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
