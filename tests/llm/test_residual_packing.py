"""Tokens against the tokenizer itself, sequences against their definition and a lower bound."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyfield.llm import queries
from tallyfield.llm import residual_packing as R


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    return Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(6)
    signs = list("abcXYZéÉßÿŸİΣσςǅﬁ²½①٣漢ん́ 0189'’.,!|<>_-\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　😀×÷ªºµ") + ["'s ", "'LL", "<|endoftext|>"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]


def test_ids_are_the_tokenizers(tokenizer, path, spark, data, monkeypatch):
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["", "x" * 30_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for cache in (250_000, 100):
        monkeypatch.setattr(R, "CACHE", cache)
        ids = R.WordIds(open(path, encoding="utf-8").read())
        for at in range(0, len(texts), 100):
            for t, a, b in zip(texts[at : at + 100], map(ids.text_ids, texts[at : at + 100]), want[at : at + 100]):
                assert a == b, repr(t[:200])


def test_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    bins, offsets, used = R.best_fit(lengths, 100)
    assert used.sum() == lengths.sum() and used.max() <= 100
    for b in range(len(used)):
        spans = sorted(zip(offsets[bins == b], lengths[bins == b]))
        assert [s for s, _ in spans] == list(np.cumsum([0] + [n for _, n in spans[:-1]]))
    open_rooms, want = [], 0  # plain best fit, longest first
    for n in sorted(lengths.tolist(), reverse=True):
        fitting = [i for i, r in enumerate(open_rooms) if r >= n]
        if fitting:
            open_rooms[min(fitting, key=lambda i: open_rooms[i])] -= n
        else:
            open_rooms.append(100 - n)
            want += 1
    assert len(used) == want


def check(rows, texts, tokenizer):
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [4096 * k for k in range(len(own))]
        for r in own:
            part = ids[doc][r["start"] : r["start"] + 4096]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for spans in by_seq.values():
        spans.sort()
        assert [s for s, _ in spans] == list(np.cumsum([0] + [n for _, n in spans[:-1]]))
        assert sum(n for _, n in spans) <= 4096
    total = sum(map(len, ids.values()))
    return len(by_seq), -(-total // 4096)


def test_rows(frame, path, tokenizer):
    texts = [None, "", "a", "Hello, World's 12!", "b " * 9000, "é" * 5000, "same", "same"] + ["w " * (i * 37 % 900) for i in range(200)]
    df = frame(texts).repartition(7)
    used, least = check(R.pack(df, path).collect(), dict(enumerate(texts)), tokenizer)
    assert used <= least + 1
    assert R.pack(frame([]), path).collect() == []
    twice = R.pack(frame(["a b", "a b"], ids=[3, 3]), path).collect()
    assert sorted(r["offset"] for r in twice) == [0, 3] and len({r["sequence_id"] for r in twice}) == 1
    assert R.pack(frame(["a"], ids=[None]), path).first()["doc_id"] is None


def test_tree_of_many_rounds(frame, path, tokenizer, monkeypatch):
    texts = ["w " * (300 + i * 131 % 3700) for i in range(300)]
    df = frame(texts).repartition(40)
    monkeypatch.setattr(R, "FAN_IN", 3)
    used, _ = check(R.pack(df, path).collect(), dict(enumerate(texts)), tokenizer)
    whole = len(R.best_fit(np.array([len(tokenizer.encode(t).ids) + 1 for t in texts]))[2])
    assert used <= 1.15 * whole  # few long pieces a partition, and bins move whole
    monkeypatch.setattr(R, "NODE_BINS", 40)  # the tree ends with several nodes
    check(R.pack(df, path).collect(), dict(enumerate(texts)), tokenizer)


def test_query(spark, data, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    used, least = check(queries.op7_residual_packing(spark, data).collect(), docs, tokenizer)
    assert used <= least + 2
