"""Fingerprints and components against all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm import gray_simhash as G
from tallyfield.llm import queries


def slow_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(d, least.get(top(p), d))
    return [(d, f"{p:016x}", least.get(top(p))) for d, p in prints]


def variants(seed=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(400)] for _ in range(8)]
    texts = []
    for k in range(120):
        w = list(base[k % 8])
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(400)] = rng.choice(vocab)
        texts.append(" ".join(w).title() if k % 3 == 0 else "\t".join(w))
    return texts + [None, "", " \n", "É\xa0b", "two words", "TWO words", texts[0], "a b c " * 40_000] + [f"{i} x" for i in range(60)]


def test_fingerprints():
    for t in variants()[:60] + variants()[120:]:
        assert G.fingerprint((t or "").encode()) == slow_print(t)


def test_against_all_pairs(frame, monkeypatch):
    texts = variants()
    want = components([(i, slow_print(t)) for i, t in enumerate(texts)])
    df = frame(texts)
    for run in (4096, 5):
        monkeypatch.setattr(G, "RUN", run)
        rows = G.near_duplicates(df).orderBy("doc_id").collect()
        assert [tuple(r)[:3] for r in rows] == want
    kept = G.keep_first(df, G.near_duplicates(df))
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for *_, c in want}


def test_dense_and_random_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:40]:
        for _ in range(5):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {1 << b for b in range(64)} | {0, (1 << 64) - 1}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    monkeypatch.setattr(G, "RUN", 16)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in G.link_fingerprints(df).collect()]
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        root[top(a)] = top(b)
    mine = {}
    for p in prints:
        mine.setdefault(top(p), set()).add(p)
    least = {}
    for i, (p, _, c) in enumerate(components(list(enumerate(prints)))):
        least.setdefault(c, set()).add(prints[i])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, least.values()))


def test_gray_rank(spark):
    got = spark.range(64).select(G.gray_rank(F.col("id").bitwiseXOR(F.shiftright("id", 1))).alias("r")).collect()
    assert [r["r"] + (1 << 63) for r in got] == list(range(64))


def test_nulls_and_repeats(frame):
    df = frame(["a b", "a b", None, "", "c", "c"], ids=[None, 7, 3, 2, 9, 9])
    found = G.near_duplicates(df)
    rows = {(r["doc_id"], r["component_id"]) for r in found.collect()}
    assert rows == {(None, 7), (7, 7), (3, 2), (2, 2), (9, 9)}
    assert sorted(r["doc_id"] for r in G.keep_first(df, found).collect()) == [2, 7, 9]
    assert G.near_duplicates(frame([])).collect() == []
    assert G.near_duplicates(frame(["x"], ids=[None])).first()["component_id"] is None


def test_rows_that_share_an_id(frame):
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    texts = [words("a"), words("a"), words("b"), words("c"), words("c"), words("c"), words("d"), words("d"), words("e"), None, ""]
    ids = [1, 2, 2, None, None, 5, None, None, 7, 7, 7]
    df = frame(texts, ids=ids)
    kept = G.keep_first(df, G.near_duplicates(df))
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    want = [(1, texts[0]), (2, texts[2]), (5, texts[3]), (None, texts[6]), (7, texts[8]), (7, "")]
    assert got == sorted(want, key=str)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op8_gray_simhash(spark, data).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows] == components([(d["doc_id"], slow_print(d["text"])) for d in docs])
