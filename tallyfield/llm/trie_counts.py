"""Token counts by a unigram model, with the forward scores shared along a trie of distinct words.

The best score of a word's prefix depends on the prefix alone. Words are inserted into a trie; each new node gets
the best score and token count of its prefix from the nodes above it, once for all words that share it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

#: A trie is started anew beyond so many nodes; that bounds memory and changes no result.
MAX_NODES = 400_000
MARK = "▁"


@dataclass
class Unigram:
    """Log probabilities of pieces. A character without a piece of its own is its UTF-8 bytes, a token each."""

    pieces: dict[str, float]
    unknown: float


def unigram_from_pieces(path: str) -> Unigram:
    """Pieces of a public vocabulary file with Zipf scores ``-log(2 + rank)`` by their rank; nothing is trained.

    Read by the driver; the model (a megabyte) is then broadcast, so executors need no such file.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): -math.log(2 + rank) for rank, i in enumerate(plain)}
    return Unigram(pieces, min(pieces.values()) - 10)


class SharedTrie:
    """Nodes are numbered; ``step[node << 21 | code point]`` is the child; scores and counts are by node."""

    def __init__(self, model: Unigram):
        self.model = model
        self.ends = {p[i:] for p in model.pieces for i in range(len(p))}  # a suffix outside of it ends no piece
        self.clear()

    def clear(self) -> None:
        self.step: dict[int, int] = {}
        self.score = [0.0]
        self.tokens = [0]
        self.terminal: dict[str, int] = {}

    def add(self, word: str) -> int:
        """Insert a word and return its number of tokens."""
        text = MARK + word
        path = [0]
        step, score, tokens = self.step, self.score, self.tokens
        pieces, ends = self.model.pieces, self.ends
        for d, ch in enumerate(text, 1):
            key = path[-1] << 21 | ord(ch)
            node = step.get(key)
            if node is None:
                node = step[key] = len(score)
                best, n = -math.inf, 0
                if ch not in pieces:
                    best, n = score[path[-1]] + self.model.unknown, tokens[path[-1]] + len(ch.encode("utf-8", "replace"))
                for s in range(d - 1, -1, -1):
                    piece = text[s:d]
                    if piece not in ends:
                        break
                    p = pieces.get(piece)
                    if p is not None and score[path[s]] + p >= best:  # of equal scores the longest last piece
                        best, n = score[path[s]] + p, tokens[path[s]] + 1
                score.append(best)
                tokens.append(n)
            path.append(node)
        self.terminal[word] = tokens[path[-1]]
        return tokens[path[-1]]

    def count(self, words: list[str]) -> int:
        """Tokens of all words, repeated ones by their stored terminal counts."""
        terminal = self.terminal
        for w in set(words).difference(terminal):
            if len(self.score) > MAX_NODES:
                return self._count_anew(words)
            self.add(w)
        return sum(map(terminal.__getitem__, words))

    def _count_anew(self, words: list[str]) -> int:
        self.clear()
        total = 0
        for w in words:
            n = self.terminal.get(w)
            if n is None:
                if len(self.score) > MAX_NODES:
                    self.clear()
                n = self.add(w)
            total += n
        return total


def count_tokens(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` for every row, in one pass without a shuffle; null text has no words.

    Words are split at white space and marked in front as the vocabulary's pieces are. Each task keeps a trie of
    the words it has met, bounded by ``MAX_NODES`` plus one document's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = SharedTrie(shared.value)
        for b in batches:
            n_words, n_tokens = [], []
            for text in strings(b.column("text")):
                words = text.split()
                n_words.append(len(words))
                n_tokens.append(trie.count(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
