"""Naive-Bayes sums of texts over their words, without a row per word.

Texts are inverted a batch at a time: a batch becomes a row per bucket of words with the words, packed into integers,
and the texts of the batch that hold them; words go in the order of their letters, as differences, and compressed. A bucket's rows meet in one task, which counts its words by class, turns
the counts into gains and sums these for the texts of each row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Words (one per position) that are inverted at a time.
_BATCH_WORDS = 4 * 1024 * 1024
#: Distinct words a bucket is sized for; also the cells (word, class) that a task merges at a time.
_BUCKET_WORDS = 4 * 1024 * 1024
#: Cells (text, class) of a batch, and its texts, whose numbers go as two bytes.
_BATCH_CELLS = 8 * 1024 * 1024
_BATCH_TEXTS = (1 << 16) - 1
#: Bytes of its rows that a task holds in memory; more are in a temporary file.
_KEPT_BYTES = 1 << 26
#: One of so many word hashes is kept to size the buckets, which balances the work and changes no result.
_SIZING = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mixed(lanes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(lanes[0]), np.uint64)
    for lane in lanes:
        out = (out ^ lane) * _MIX
        out ^= out >> np.uint64(32)
    return out


def _look(k: int):
    """The code points of the texts, and the kept ones of their word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for b in batches:
            kept = [np.zeros(0, np.uint64)]
            for text in b.column(0).to_pylist():
                x = _code_points(text or "")
                seen[x] = True
                if len(x) >= k:
                    h, width = _mixed([x]), 1
                    while width < k:  # two hashed words, that may overlap, make a longer one
                        step = min(width, k - width)
                        h, width = h[:-step] * _MIX + h[step:], width + step
                        h ^= h >> np.uint64(29)
                    h *= _MIX
                    kept.append(h[h < (1 << 64) // _SIZING])
            h = np.unique(np.concatenate(kept)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.array(h)], names=["code", "kept"])
        codes = np.flatnonzero(seen).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.nulls(len(codes), pa.int64())], names=["code", "kept"])

    return run


def _lanes(x: np.ndarray, k: int, letters: int) -> list[np.ndarray]:
    """Every ``k`` consecutive letters, packed exactly into as few 64-bit integers as hold them.

    The first integer is mixed with the others, which can be undone: words stay apart, and their order is that of buckets.
    """
    bits = max(1, (letters - 1).bit_length())
    n, per = len(x) - k + 1, 64 // bits
    out = []
    for first in range(0, k, per):
        lane = np.zeros(n, np.uint64)
        for i in range(first, min(k, first + per)):
            lane <<= np.uint64(bits)
            lane |= x[i : i + n]
        out.append(lane)
    return [_mixed([*out[1:], out[0]]), *out[1:]]


def _starts(lanes: list[np.ndarray]) -> np.ndarray:
    """Whether a sorted row differs from the one before."""
    out = np.zeros(len(lanes[0]), bool)
    out[:1] = True
    for lane in lanes:
        out[1:] |= lane[1:] != lane[:-1]
    return out


def _order(lanes: list[np.ndarray]) -> np.ndarray:
    """Stable order of words: sorted by the mixed integer's high bits with the place below, if these tell words apart."""
    bits = np.uint64(len(lanes[0]).bit_length())
    key = lanes[0] >> bits << bits
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    if (_starts([lane[order] for lane in lanes]) & ~_starts([key])).any():
        return np.lexsort(lanes[::-1])
    return order


def _find(table: list[np.ndarray], lanes: list[np.ndarray]) -> np.ndarray:
    """The place of each word in a sorted table of distinct ones, -1 if it is not there."""
    n = len(table[0])
    if not n:
        return np.full(len(lanes[0]), -1)
    if len(lanes) == 1:
        place = np.minimum(np.searchsorted(table[0], lanes[0]), n - 1)
        return np.where(table[0][place] == lanes[0], place, -1)
    both = [np.concatenate(x) for x in zip(table, lanes)]
    order = np.lexsort(both[::-1])  # stable, so the table's word comes first of equal ones
    first = order[np.maximum.accumulate(np.where(_starts([x[order] for x in both]), np.arange(len(order)), 0))]
    out = np.empty(len(order), np.int64)
    out[order] = np.where(first < n, first, -1)
    return out[n:]


def _unmixed(lanes: list[np.ndarray]) -> np.ndarray:
    """The first integer of ``_lanes`` as it was before it was mixed with the others."""
    x = lanes[0] ^ (lanes[0] >> np.uint64(32))
    x *= np.uint64(pow(int(_MIX), -1, 1 << 64))
    return x ^ _mixed(lanes[1:]) if len(lanes) > 1 else x


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as their count and their bytes, those of one rank after those of another, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unsqueezed(buffer: pa.Buffer, kind: type) -> np.ndarray:
    n, size = int.from_bytes(buffer[:8].to_pybytes(), "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(buffer[8:], n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _moved(held: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the texts of words when the words are put into an order."""
    held = held.astype(np.int64)
    now = held[order]
    return np.arange(int(now.sum())) + np.repeat((np.cumsum(held) - held)[order] - (np.cumsum(now) - now), now)


def _written_small(lanes: list[np.ndarray], held: np.ndarray, texts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Words, by how many texts each is held, and by which ones, in the order of letters, in which neighbours are alike."""
    plain = [_unmixed(lanes), *lanes[1:]]
    order = np.lexsort(plain[::-1]) if len(plain) > 1 else np.argsort(plain[0])
    first, *others = (x[order] for x in plain)
    words = np.concatenate([np.diff(first, prepend=np.uint64(0)), *others])
    return _squeezed(words), _squeezed(held[order]), _squeezed(texts[_moved(held, order)])


def _read_small(words: pa.Buffer, held: pa.Buffer, texts: pa.Buffer, lanes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What ``_written_small`` was given."""
    first, *others = _unsqueezed(words, np.uint64).reshape(lanes, -1)
    first = np.cumsum(first, dtype=np.uint64)
    held, texts = _unsqueezed(held, np.uint16), _unsqueezed(texts, np.uint16)
    own = [_mixed([*others, first]), *others]
    order = np.lexsort(own[::-1]) if lanes > 1 else np.argsort(own[0])
    return [x[order] for x in own], held[order], texts[_moved(held, order)]


def _packed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _invert(shared, k: int, buckets: int, texts: int):
    """A row per batch of texts and bucket: its words, by how many texts each is held, and by which ones."""

    def part(b: pa.RecordBatch, table: np.ndarray, letters: int) -> Iterator[pa.RecordBatch]:
        own = [t or "" for t in b.column(3).to_pylist()]
        x = table[_code_points("".join(own))]
        n = len(x) - k + 1
        if n <= 0:
            return
        text = np.repeat(np.arange(len(own)), [len(t) for t in own])
        inside = text[:n] == text[k - 1 :]
        lanes, text = [lane[inside] for lane in _lanes(x, k, letters)], text[:n][inside]
        if not len(text):
            return
        order = _order(lanes)
        lanes = [lane[order] for lane in lanes]
        new = _starts(lanes)
        lanes = [lane[new] for lane in lanes]
        text = text[order]
        once = _starts([text]) | new  # a text holds a word once
        word, text = (np.cumsum(new) - 1)[once], text[once].astype(np.uint16)
        held = np.bincount(word, minlength=len(lanes[0]))
        bucket = ((lanes[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        at = np.flatnonzero(_starts([bucket]))
        some, ends = bucket[at], np.append(at[1:], len(bucket))
        last = np.cumsum(held)[ends - 1]
        words = [slice(*x) for x in zip(at, ends)]
        pairs = [slice(*x) for x in zip(last - np.add.reduceat(held, at), last)]
        held = held.astype(np.uint16)
        ids = b.column(0)
        small = [_written_small([lane[w] for lane in lanes], held[w], text[p]) for w, p in zip(words, pairs)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(ids), pa.int32()), pa.concat_arrays([ids] * len(some))),
                _packed([b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)] * len(some)),
                _packed([b.column(2).fill_null(-1).to_numpy().astype(np.int32)] * len(some)),
                *(pa.array(part, pa.binary()) for part in zip(*small)),
            ],
            names=["bucket", "ids", "asked", "classes", "words", "held", "texts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x110000, np.uint32)
        table[shared.value] = np.arange(len(shared.value))
        for b in batches:
            at, size = 0, 0
            for i, n in enumerate(pa.compute.utf8_length(b.column(3)).to_pylist()):
                if i > at and (size + (n or 0) > _BATCH_WORDS or i - at >= texts):
                    yield from part(b.slice(at, i - at), table, len(shared.value))
                    at, size = i, 0
                size += n or 0
            if at < b.num_rows:
                yield from part(b.slice(at), table, len(shared.value))

    return run


def _rows(b: pa.RecordBatch, lanes: int):
    """The rows of a batch made by ``_invert``, unpacked; ``texts`` holds those of one word after the other."""
    one = lambda c, i, kind: np.frombuffer(b.column(c)[i].as_buffer(), kind)
    for i in range(b.num_rows):
        small = (b.column(c)[i].as_buffer() for c in ("words", "held", "texts"))
        yield b.column("ids")[i].values, one("asked", i, np.uint8).astype(bool), one("classes", i, np.int32), *_read_small(*small, lanes)


class _Counts:
    """Training texts by (word, class): sorted cells, and new ones that are merged when they are many."""

    def __init__(self, lanes: int, classes: int):
        self.lanes, self.classes, self.pending = lanes, classes, 0
        self.parts = [([np.zeros(0, np.uint64)] * lanes, np.zeros(0, np.int32), np.zeros(0, np.int64))]

    def add(self, classes: np.ndarray, words: list[np.ndarray], held: np.ndarray, texts: np.ndarray) -> None:
        cell = np.repeat(np.arange(len(held)) * self.classes, held)
        own = classes[texts]
        cells, n = np.unique((cell + own)[own >= 0], return_counts=True)
        word = cells // self.classes
        self.parts.append(([w[word] for w in words], (cells % self.classes).astype(np.int32), n))
        self.pending += len(cells)
        if self.pending > max(_BUCKET_WORDS, len(self.parts[0][1])):
            self.merge()

    def merge(self) -> None:
        words = [np.concatenate([p[0][j] for p in self.parts]) for j in range(self.lanes)]
        klass, n = (np.concatenate([p[j] for p in self.parts]) for j in (1, 2))
        self.parts = []
        order = np.lexsort([klass, *words[::-1]])
        words, klass = [w[order] for w in words], klass[order]
        at = np.flatnonzero(_starts([*words, klass]))
        n = np.add.reduceat(n[order], at) if len(at) else n
        self.parts, self.pending = [([w[at] for w in words], klass[at], n)], 0


def _score(k: int, letters: int, classes: int, none: int, total: int):
    """Sums of the texts of each row over the words of a task, whose rows hold all texts with these words."""
    lanes = len(_lanes(np.zeros(k, np.uint32), k, letters))
    unseen = np.log(0.5 / (total + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(lanes, classes)
        # the rows are read twice: for the counts, and for the sums
        with tempfile.SpooledTemporaryFile(_KEPT_BYTES) as f:
            kept = None
            for b in batches:
                kept = kept or pa.ipc.new_stream(f, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                kept.write_batch(b)
                for _, _, own, words, held, texts in _rows(b, lanes):
                    counts.add(own, words, held, texts)
            if kept is None:
                return
            kept.close()
            counts.merge()
            (words, klass, n), counts = counts.parts[0], None
            new = _starts(words)
            at = np.flatnonzero(new)
            table = [w[at] for w in words]
            prior = (np.add.reduceat(n, at) + 0.5) / (total + 1) if len(at) else np.zeros(0)
            named = klass != none  # texts without a class count in the prior and as a word not seen
            pw = prior[np.cumsum(new) - 1]
            gain = np.log((n + pw) / pw)[named]
            per = np.add.reduceat(named.astype(np.int64), at) if len(at) else at
            nameless = np.diff(np.append(at, len(klass))) > per
            first, klass = np.cumsum(per) - per, klass[named]
            # a word's class-free part and how often it counts; the last entry is that of words not in the table
            flat = np.append((per > 0) * np.log(prior) + nameless * unseen, unseen)
            times = np.append((per > 0) + nameless.astype(np.int64), 1)
            first, per = np.append(first, 0), np.append(per, 0)
            f.seek(0)
            for b in pa.ipc.open_stream(f):
                for ids, asked, _, words, held, texts in _rows(b, lanes):
                    if not asked.any():
                        continue
                    place = _find(table, words)
                    word = np.repeat(np.arange(len(place)), held)
                    if not asked.all():
                        mine = asked[texts]
                        word, texts = word[mine], texts[mine]
                    lp, nq, own, at = flat[place], times[place], per[place], first[place]
                    size = len(asked)
                    g = np.zeros(size * classes)
                    ends = np.cumsum(own[word])
                    step = np.searchsorted(ends, np.arange(_BUCKET_WORDS, ends[-1] if len(ends) else 0, _BUCKET_WORDS))
                    for w, t in zip(np.split(word, step), np.split(texts, step)):
                        many = own[w]
                        entry = np.arange(many.sum()) + np.repeat(at[w] - (np.cumsum(many) - many), many)
                        cell = np.repeat(t.astype(np.int64) * classes, many) + klass[entry]
                        g += np.bincount(cell, gain[entry], len(g))
                    cells = np.flatnonzero(g).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), ids), _packed([cells]), _packed([g[cells]]),
                            _packed([np.bincount(texts, lp[word], size)]),
                            _packed([np.bincount(texts, nq[word], size).astype(np.int64)]),
                        ],
                        names=["ids", "cells", "g", "flat", "nq"],
                    )

    return run


def _sum_rows(classes: int):
    """The sums of a batch of texts over all buckets, a row per text and class and one per text."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows["ids"][0].values
        size = len(ids)
        get = lambda c, kind: [np.frombuffer(v.as_buffer(), kind) for v in rows[c]]
        g, flat, nq = np.zeros(size * classes), np.zeros(size), np.zeros(size, np.int64)
        for c, x, f, q in zip(get("cells", np.int32), get("g", np.float64), get("flat", np.float64), get("nq", np.int64)):
            g[c] += x
            flat += f
            nq += q
        cells, some = np.flatnonzero(g), np.flatnonzero(nq)
        text = np.concatenate([cells // classes, some])
        klass = np.concatenate([cells % classes, np.zeros(len(some), np.int64)])
        free = np.arange(len(text)) >= len(cells)
        return pa.table(
            {
                "seq_id": ids.take(pa.array(text)), "class": pa.array(klass.astype(np.int32), mask=free),
                "g": np.concatenate([g[cells], np.zeros(len(some))]),
                "flat": np.concatenate([np.zeros(len(cells)), flat[some]]),
                "nq": np.concatenate([np.zeros(len(cells), np.int64), nq[some]]),
            }
        )

    return run


def class_sums(texts: DataFrame, k: int, classes: int, none: int, total: int) -> DataFrame:
    """``(seq_id, class, g, flat, nq)`` of ``texts(seq_id, asked, class, seq)``, to be summed by ``seq_id`` and ``class``.

    Texts with a ``class`` (0 to ``classes - 1``) train, ``asked`` ones are scored; a text may do both, and is then moved
    once. ``g`` sums the gains of the words that a class has seen; the row without ``class`` holds the sum of the
    words' log priors and their number. ``none`` is the class of texts without a name, ``total`` the number of training texts.
    Buckets follow the distinct words, so that a task holds the cells of some four million words and a batch of texts.
    """
    spark = texts.sparkSession
    kind = texts.schema["seq_id"].dataType.simpleString()
    texts = texts.selectExpr("seq_id", "asked", "CAST(class AS INT) AS class", "seq")
    found = checkpointed(texts.select("seq").mapInArrow(_look(k), "code int, kept long").distinct())
    letters = np.array(sorted(r["code"] for r in found.where("code IS NOT NULL").collect()), np.int64)  # of Unicode's
    words = _SIZING * found.where("kept IS NOT NULL").count()
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-words // _BUCKET_WORDS))
    binary = ", ".join(f"{c} binary" for c in ("asked", "classes", "words", "held", "texts"))
    inverted = texts.mapInArrow(
        _invert(spark.sparkContext.broadcast(letters), k, buckets, max(1, min(_BATCH_TEXTS, _BATCH_CELLS // classes))),
        f"bucket int, ids array<{kind}>, {binary}",
    )
    scored = inverted.repartitionById(buckets, "bucket").mapInArrow(
        _score(k, len(letters), classes, none, total), f"ids array<{kind}>, cells binary, g binary, flat binary, nq binary"
    )
    return scored.groupBy("ids").applyInArrow(_sum_rows(classes), f"seq_id {kind}, class int, g double, flat double, nq long")
