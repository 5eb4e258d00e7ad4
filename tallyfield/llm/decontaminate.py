"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its documents into shards and sorts the shard's suffixes; every suffix of the benchmark is found in
it by binary search. A suffix that shares no first words with any benchmark window can't be found by such a search
and is left out of the array. Found ranges give all places; from each start the match is followed to its full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

WINDOW = 10
#: UTF-8 bytes of documents in a shard, and of benchmark texts in a block that is broadcast at once.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256)
)
_HEAD = 4  # words that a suffix must share with a window to be in the array
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters a to z (A to Z lower-cased) and bytes beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def _heads(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    code = ids[at].astype(np.uint64)
    for j in range(1, n):
        code = (code * _MIX) ^ ids[at + j].astype(np.uint64)
    return code


def _keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first WINDOW word numbers of each suffix, as strings that sort like them."""
    found = ids[at[:, None] + np.arange(WINDOW)].astype(">u4")
    return np.ascontiguousarray(found).view(f"S{4 * WINDOW}").ravel()


@dataclass
class Block:
    """A part of the benchmark: word numbers from 1 (0 ends a text) and its distinct windows."""

    vocab: dict[bytes, int]
    ids: np.ndarray
    names: list[str | bytes]  # an item without an id is named by the bytes of a digest of its text
    item_of: np.ndarray  # item of each position in ids
    start_of: np.ndarray  # first position of that item
    low: np.ndarray  # key range of each distinct window
    high: np.ndarray
    length: np.ndarray
    places: np.ndarray  # positions of the windows, by window
    first: np.ndarray  # where a window's places begin

    @staticmethod
    def of(items: list[tuple[str | None, bytes]]) -> "Block":
        vocab: dict[bytes, int] = {}
        ids, item_of, start_of, starts, sizes, names = [], [], [], [], [], []
        for name, text in items:
            own = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
            if not own:
                continue
            at = len(ids)
            n = min(WINDOW, len(own))
            starts += range(at, at + len(own) - n + 1)
            sizes += [n] * (len(own) - n + 1)
            ids += own + [0]
            item_of += [len(names)] * (len(own) + 1)
            start_of += [at] * (len(own) + 1)
            names.append(hashlib.sha256(text).digest() if name is None else name)
        array = np.array(ids + [0] * WINDOW, np.int64)
        at, size = np.array(starts, np.int64), np.array(sizes, np.int64)
        inside = np.arange(WINDOW) < size[:, None]
        cells = array[at[:, None] + np.arange(WINDOW)]
        width = f"S{4 * WINDOW}"

        def key(fill: int) -> np.ndarray:
            return np.ascontiguousarray(np.where(inside, cells, fill).astype(">u4")).view(width).ravel()

        low, high = key(0), key(0xFFFFFFFF)
        _, some, window = np.unique(low, return_index=True, return_inverse=True)
        order = np.argsort(window, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(window, minlength=len(some)))]).astype(np.int64)
        return Block(vocab, array, names, np.array(item_of, np.int64), np.array(start_of, np.int64), low[some], high[some],
                     size[some], at[order], first)

    def find(self, docs: list[list[bytes]], ends: np.ndarray):
        """``(position, window)`` of all places of windows in the documents' words, 0 between documents."""
        ids = np.zeros(int(ends[-1]) + WINDOW + 1, np.int64)
        for own, end in zip(docs, ends.tolist()):
            ids[end - len(own) - 1 : end - 1] = np.fromiter(map(self.vocab.get, own, repeat(0)), np.int64, len(own))
        some = np.flatnonzero(ids)
        listed = np.zeros(len(some), bool)
        for n in np.unique(np.minimum(self.length, _HEAD)).tolist():
            mine = self.places[self.first[:-1]][np.minimum(self.length, _HEAD) == n]
            wanted = np.unique(_heads(self.ids, mine, n))
            got = _heads(ids, some, n)
            listed |= wanted[np.minimum(np.searchsorted(wanted, got), len(wanted) - 1)] == got
        suffixes = some[listed]
        keys = _keys(ids, suffixes)
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        return ids, suffixes[np.arange(len(window)) - np.repeat(begin, n) + np.repeat(low, n)], window

    def longest(self, ids: np.ndarray, at: np.ndarray, window: np.ndarray):
        """Full matches ``(position, length, place)`` from the places where no longer one begins before."""
        n = (self.first[1:] - self.first[:-1])[window]
        t = np.repeat(at, n)
        begin = np.cumsum(n) - n
        q = self.places[np.arange(len(t)) - np.repeat(begin, n) + np.repeat(self.first[window], n)]
        before = np.where((t > 0) & (q > 0), (ids[t - 1] == self.ids[q - 1]) & (ids[t - 1] > 0), False)
        t, q, size = t[~before], q[~before], np.repeat(self.length[window], n)[~before]
        live = np.arange(len(t))
        while len(live):
            a, b = t[live] + size[live], q[live] + size[live]
            live = live[(ids[a] > 0) & (ids[a] == self.ids[b])]
            size[live] += 1
        return t, size, q


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Broadcast]:
    """The benchmark as broadcast blocks of about ``BLOCK_BYTES`` of text each; null texts are left out.

    The benchmark is the stated query set; one block at a time comes to the driver.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).dropna(subset=["text"])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r))
        out.append(benchmark.sparkSession.sparkContext.broadcast(Block.of([(i, t.encode()) for i, t in rows])))
    return out


def scan_shard(texts: list[bytes], blocks: list[Block]) -> list[tuple]:
    """``(n_words, n_hit, items, longest, start, item, item_start)`` of each text."""
    docs = [words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    change = np.zeros(int(ends[-1]) + 1, np.int64)
    items: dict[int, set[str]] = {}
    best: dict[int, tuple] = {}
    for block in blocks:
        if not len(block.low):
            continue
        ids, at, window = block.find(docs, ends)
        if not len(at):
            continue
        change += np.bincount(at, minlength=len(change)) - np.bincount(at + block.length[window], minlength=len(change))
        doc = np.searchsorted(begins, at, "right") - 1
        for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
            own = block.item_of[block.places[block.first[w] : block.first[w + 1]]]
            items.setdefault(d, set()).update(block.names[i] for i in own)
        t, size, q = block.longest(ids, at, window)
        for d, p, n, place in zip((np.searchsorted(begins, t, "right") - 1).tolist(), t.tolist(), size.tolist(), q.tolist()):
            name = block.names[block.item_of[place]]
            found = (-n, p - int(begins[d]), isinstance(name, bytes), name, place - int(block.start_of[place]))
            if d not in best or found < best[d]:
                best[d] = found
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    out = []
    for d in range(len(docs)):
        n = best.get(d, (0, None, True, None, None))
        name = None if n[2] else n[3]
        out.append((int(sizes[d]), int(hit[ends[d] - 1] - hit[begins[d]]), items.get(d, set()), -n[0], n[1], name, n[4]))
    return out


def _shards(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SHARD_BYTES or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def contamination(docs: DataFrame, blocks: list[Broadcast], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: how many of its words lie in a benchmark window, and in which items.

    ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_words, longest_start, longest_item,
    longest_item_start)``: the last four tell the longest verbatim match, ties by the earliest place (null if
    none). Null text has no words. An item without an id is searched and counted like others, equal texts as one, but it has no
    name in ``items_sha256`` and ``longest_item``. Rows don't meet, so there is no shuffle and repeated rows repeat their result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.value for b in blocks]
        for b in slices(batches):
            texts = utf8(b.column("text"))
            rows = [r for i, j in _shards(texts) for r in scan_shard(texts[i:j], own)]
            lists = [",".join(sorted(x for x in r[2] if isinstance(x, str))) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists]),
                    pa.array([r[1] > 0 for r in rows]),
                    *[pa.array([r[k] for r in rows], t) for k, t in ((3, pa.int64()), (4, pa.int64()), (5, pa.string()), (6, pa.int64()))],
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words",
                       "longest_start", "longest_item", "longest_item_start"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "longest_words long, longest_start long, longest_item string, longest_item_start long"
    )


def drop_contaminated(docs: DataFrame, blocks: list[Broadcast], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, of which no word lies in a benchmark window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.value for b in blocks]
        for b in slices(batches):
            texts = utf8(b.column(text_col))
            clean = [r[1] == 0 for i, j in _shards(texts) for r in scan_shard(texts[i:j], own)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
