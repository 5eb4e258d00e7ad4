"""Hierarchical residual packing of token sequences.

Each partition packs its pieces by best fit, longest first. Bins with at most ``SLACK`` tokens free are done; the
others become items of the next round, in which ``FAN_IN`` neighbouring nodes of the tree are packed as one.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, small_batches, strings

CAPACITY = 4096
SLACK = 4
FAN_IN = 16
#: Underfull bins that one node packs at most; the tree ends with so many nodes as that needs. A larger node would
#: hardly pack better, and no bin is left out.
NODE_BINS = 500_000
END_ID = 1
#: Entries of a worker's word cache.
CACHE = 400_000

_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PRE = re.compile("[a-zà-öø-ÿß]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9à-öø-ÿß]+")


class WordIds(dict):
    """Token ids of words as little-endian 32-bit bytes; up to ``CACHE`` words are remembered, others encoded anew.

    The tokenizer lower-cases, drops white space and never joins across it. Text of ASCII and plain Latin letters is
    cut as its pre-tokenizer does and only merged by it; other text is cut at white space, and chunks with other
    characters are encoded by it whole, under a name that starts with a space, as no word does.
    """

    def __init__(self, file: str):
        super().__init__()
        # one thread a task, as Spark deals out the cores; threads would keep memory of their own, too
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_str(file)
        self.merge = Tokenizer(self.whole.model)
        self.merge.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if word[:1] == " ":
            return self._encode(self.whole, word[1:])
        ids = self._encode(self.merge, word)
        if len(self) < CACHE:
            self[word] = ids
        return ids

    @staticmethod
    def _encode(tokenizer, text: str) -> bytes:
        return array("I", tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def text_ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PRE.findall(text.lower())))
        words: list[str] = []
        for chunk in re.split("[\t-\r ]+", text):
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                words += _PRE.findall(chunk.lower())
            else:
                words.append(" " + chunk)
        return b"".join(map(self.__getitem__, words))


_WORKER: dict[int, WordIds] = {}


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and the fill of each bin. Linear in the items."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    some = 0  # bit r: a bin has r tokens of room
    used: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            free[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offsets, np.array(used, np.int64)


def local_bins(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed inside their partition: the round before the tree.

    ``(doc_id, piece, start, length, ids_crc32, node, bin, offset, used)``; ``used`` is the fill of the piece's bin.
    A partition's pieces are 40 bytes each here; ids don't leave the task. A task that runs again packs the same
    rows the same way. The tokenizer's file (megabytes) is read by the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(file.value.encode())
        if key not in _WORKER:  # a worker process serves many tasks
            _WORKER.clear()
            _WORKER[key] = WordIds(file.value)
        ids = _WORKER[key]
        docs_, pieces, starts, lengths, sums = [], [], [], [], []
        last = END_ID.to_bytes(4, "little")
        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), strings(b.column("text"))):
                own = ids.text_ids(text) + last
                for k, first in enumerate(range(0, len(own), 4 * CAPACITY)):
                    piece = own[first : first + 4 * CAPACITY]
                    docs_.append(doc)
                    pieces.append(k)
                    starts.append(first // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
        if not docs_:
            return
        bins, offsets, used = best_fit(np.array(lengths, np.int64))
        node = TaskContext.get().partitionId()
        for at in range(0, len(docs_), 50_000):
            s = slice(at, at + 50_000)
            own = bins[s]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs_[s], pa.int64()), pa.array(pieces[s], pa.int32()), pa.array(starts[s], pa.int64()),
                    pa.array(lengths[s], pa.int64()), pa.array(sums[s], pa.int64()), pa.array(np.full(len(own), node, np.int64)),
                    pa.array((node << 40) + own), pa.array(offsets[s]), pa.array(used[own]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "node", "bin", "offset", "used"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long, used long"
    )


def _pack_node(bins: pd.DataFrame) -> pd.DataFrame:
    bins = bins.sort_values("bin", kind="stable")
    to, offset, used = best_fit(bins["used"].to_numpy())
    names = bins["bin"].to_numpy()
    leader = np.empty(len(used), np.int64)
    head = offset == 0
    leader[to[head]] = names[head]
    return pd.DataFrame({"node": bins["node"], "bin": names, "to": leader[to], "shift": offset, "used": used[to]})


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row.

    Null text is an empty document of the end id alone; repeated rows are packed each. Sequences hold at most
    ``CAPACITY`` tokens; offsets are gapless from 0. Only longer documents are cut.
    """
    with small_batches(docs.sparkSession):
        pieces = checkpointed(local_bins(docs, tokenizer_path, id_col, text_col))
    free = CAPACITY - SLACK
    open_bins = checkpointed(pieces.where(F.col("used") < free).select("node", "bin", "used").distinct())
    place = open_bins.select("bin", F.col("bin").alias("to"), F.lit(0).cast("long").alias("shift"))
    last = open_bins.agg(F.max("node"), F.count("*")).first()
    nodes, count = (last[0] or 0) + 1, last[1]
    while nodes > 1 and count > 1:
        least = max(1, -(-count // NODE_BINS))
        step = min(FAN_IN, -(-nodes // least))
        if step < 2:
            break
        nodes = -(-nodes // step)
        packed = checkpointed(
            open_bins.withColumn("node", F.expr(f"node div {step}"))
            .groupBy("node").applyInPandas(_pack_node, "node long, bin long, to long, shift long, used long")
        )
        moved = packed.select(F.col("bin").alias("to"), F.col("to").alias("__to"), F.col("shift").alias("__shift"))
        place = checkpointed(
            place.join(moved, "to", "left").select(
                "bin", F.coalesce("__to", "to").alias("to"), (F.col("shift") + F.coalesce("__shift", F.lit(0))).alias("shift")
            )
        )
        open_bins = packed.where((F.col("bin") == F.col("to")) & (F.col("used") < free)).select("node", "bin", "used")
        count = open_bins.count()
    return pieces.join(place, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
