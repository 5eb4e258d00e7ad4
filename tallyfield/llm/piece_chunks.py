"""SentencePiece ids by a table of distinct chunks, joined back by position.

White space is written as a mark, and a word begins with its marks. Where no piece of the vocabulary has a mark after
another character, no merge crosses into the next word: a word's ids are the same in every text. So a task segments each
distinct word once, in batches, and a text's ids are those of its words in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, slices

MARK = "▁"
#: Characters of the words that a worker remembers beyond a slice's own; then the table starts anew.
TABLE_CHARS = 4_000_000
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids of distinct words. ``model`` is the content of a SentencePiece file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in names):
            raise ValueError("a piece of this vocabulary crosses a white space mark")
        # words are only cut as the library does where it changes nothing else in a text
        for probe in ("a  b ", "ﬁ Ａ́\t ", MARK + "x"):
            if sp.normalize(probe) != (MARK + probe).replace(" ", MARK):
                raise ValueError("this vocabulary normalises texts")
        self.lone = sp.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        """Words by number; the ids of word ``i`` are ``flat[first[i] : first[i + 1]]``."""
        self.number: dict[str, int] = {}
        self.flat, self.first, self.chars = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    @staticmethod
    def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The marked words of all texts without their first mark, and the number of each text; an empty text has none."""
        marked = pc.replace_substring(texts.cast(pa.large_string()), " ", MARK)
        odd = pc.or_(pc.match_substring(marked, MARK + MARK), pc.match_substring_regex(marked, f"^{MARK}|{MARK}$|^$"))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(marked.filter(pa.array(~odd)), MARK)
        others = [[w[1:] for w in _MARKED.findall(MARK + t)] if t else [] for t in marked.filter(pa.array(odd)).to_pylist()]
        counts = np.empty(len(odd), np.int64)
        counts[~odd] = plain.value_lengths().to_numpy(zero_copy_only=False)
        counts[odd] = list(map(len, others))
        words = pa.concat_arrays([plain.flatten(), pa.array(list(chain.from_iterable(others)), pa.large_string())])
        if odd.any():  # back in the order of the texts
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            starts = np.empty(len(odd), np.int64)
            starts[order] = np.cumsum(counts[order]) - counts[order]
            words = words.take(pa.array(np.arange(len(words)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)))
        return words, counts

    def add(self, words: list[str]) -> None:
        # the library puts the first mark in front of every word; a mark alone is the one word it can't be given
        found = [i or [self.lone] for i in self.sp.encode(words, num_threads=1)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.chars += sum(map(len, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of ids of each."""
        if self.chars > TABLE_CHARS:
            self.clear()
        words, counts = self.words(texts)
        chunks = words.dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.number]
        if new:
            self.add(new)
        which = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        sizes = (self.first[1:] - self.first[:-1])[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.first[which] - (ends - sizes), sizes)]
        last = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(np.concatenate([[0], ends])[last])


_WORKER: dict[int, ChunkTable] = {}


def _table(model: bytes) -> ChunkTable:
    """A worker process serves many tasks; it keeps the table of one model."""
    if hash(model) not in _WORKER:
        _WORKER.clear()
        _WORKER[hash(model)] = ChunkTable(model)
    return _WORKER[hash(model)]


def _shared(df: DataFrame, model_path: str):
    """The vocabulary file (half a megabyte), read by the driver and broadcast, so that executors need no such file."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row, without begin and end ids, in one pass without a shuffle.

    Null and empty texts have no ids; repeated rows and null ids give a row each. Memory follows ``TABLE_CHARS``, a slice's
    distinct words and the longest text.
    """
    model = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.value)
        for b in byte_slices(batches, 1):
            flat, counts = table.encode(pc.fill_null(b.column(1), ""))
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the texts of its ids by the library; null ids give an empty text.

    ``name`` takes the place of a column of that name.
    """
    model = _shared(encoded, model_path)
    kept = [c for c in encoded.columns if c != name]
    ids = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _table(model.value).sp
        for b in slices(batches):
            made = sp.decode([x or [] for x in b.column(ids).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*kept, name])

    encoded = encoded.select(kept)
    return encoded.mapInArrow(run, encoded.withColumn(name, F.lit("")).schema)
