"""Trie counts against a plain forward pass and a public unigram encoder."""

import math
import random

import pytest

from tallyfield.llm import queries
from tallyfield.llm import trie_counts as T


def plain(model, word):
    """Best score and its tokens at every position of one word, from scratch."""
    text = T.MARK + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for end in range(1, len(text) + 1):
        ch = text[end - 1]
        if ch not in model.pieces:
            s, n = best[end - 1]
            best[end] = (s + model.unknown, n + len(ch.encode()))
        for start in range(end - 1, -1, -1):
            p = model.pieces.get(text[start:end])
            if p is not None and best[start][0] + p >= best[end][0]:
                best[end] = (best[start][0] + p, best[start][1] + 1)
    return best[-1][1]


@pytest.fixture(scope="module")
def model():
    return T.unigram_from_pieces(queries.vocabulary("piece_bpe_32k.model"))


def sample_words():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzéüß漢字😀́%|"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["the", "thesis", "a" * 5000]


def test_against_plain_forward_pass(model):
    trie = T.SharedTrie(model)
    for w in sample_words():
        assert trie.add(w) == plain(model, w)


def test_against_unigram_encoder(model, data, spark):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0)] + list(model.pieces.items()) + [(f"<0x{b:02X}>", model.unknown - 99) for b in range(256)]
    encoder = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    trie = T.SharedTrie(model)
    words = {w for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect() for w in r["text"].split()}
    for w in sorted(words):
        assert trie.add(w) == len(encoder.encode(T.MARK + w).ids), w


def test_rows_and_bounded_trie(frame, model, monkeypatch):
    texts = [None, "", "  \n", "one two two", "one two two", " ".join(sample_words()), "w" * 20_000, "ab " * 50_000]
    want = [sum(plain(model, w) for w in (t or "").split()) for t in texts[:6]]
    for nodes in (400_000, 50):
        monkeypatch.setattr(T, "MAX_NODES", nodes)
        trie = T.SharedTrie(model)
        assert [trie.count((t or "").split()) for t in texts[:6]] == want
    rows = T.count_tokens(frame(texts), model).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows][:6] == want
    assert [r["n_words"] for r in rows] == [len((t or "").split()) for t in texts]
    assert T.count_tokens(frame([]), model).collect() == []
