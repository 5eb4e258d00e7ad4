"""Benchmark matches against a scan of every window."""

import hashlib
import random
import re

from tallyfield.llm import decontaminate as D
from tallyfield.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    windows = {}
    for name, t in items:
        w = split(t)
        if not w:
            continue
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(("unnamed", t) if name is None else str(name))
    out = []
    for t in texts:
        w = split(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    found |= names
                    hit[i : i + n] = [True] * n
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(x for x in found if isinstance(x, str))).encode()).hexdigest(), any(hit)))
    return out


def longest(text, items):
    w, best = split(text), 0
    for _, t in items:
        b = split(t)
        least = min(10, len(b))
        for i in range(len(w)):
            for j in range(len(b)):
                n = 0
                while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                    n += 1
                if n >= least > 0:
                    best = max(best, n)
    return best


def cases():
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(30)] + ["Été", "x1", "ÉTÉ"]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([25, 12, 10, 9, 3, 40, 11])]
    items += [(7, items[0][1]), (8, "solo"), (9, ""), (10, None), (None, "v1 v2"), (11, "--"), (2, "v3 v4 v5 v6 v7 v8 v9 v1 v2 v3 v4")]
    texts = [None, "", "...", "Solo!", "v1 v2"]
    for _ in range(120):
        t = words(rng.randrange(0, 60))
        if rng.random() < 0.6:
            b = split(items[rng.randrange(7)][1])
            i = rng.randrange(len(b))
            at = rng.randrange(len(t) + 1)
            t[at:at] = b[i : i + rng.randrange(1, 30)]
        texts.append(rng.choice([" ", "-", "\n", ", "]).join(t).title() if rng.random() < 0.2 else " ".join(t))
    return texts + [items[0][1] * 2, " ".join(["v1"] * 50_000), texts[9], texts[9]], items


def test_against_every_window(spark, frame, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(texts)
    want = brute(texts, items)
    full = [longest(t, items) for t in texts[:100]]
    for shard, block in ((4 << 20, 16 << 20), (300, 200)):
        monkeypatch.setattr(D, "SHARD_BYTES", shard)
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        rows = D.contamination(df, D.benchmark_blocks(bench)).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows] == want
        assert [r["longest_words"] for r in rows][:100] == full
        for r in rows:
            if r["longest_words"]:
                w = split(texts[r["doc_id"]])[r["longest_start"] :][: r["longest_words"]]
                names = [None if i is None else str(i) for i, _ in items]
                assert any(split(t)[r["longest_item_start"] :][: r["longest_words"]] == w for i, (_, t) in zip(names, items) if i == r["longest_item"])
        kept = D.drop_contaminated(df, D.benchmark_blocks(bench))
        assert kept.columns == df.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if not w[4]}


def test_items_without_an_id(spark, frame):
    w = [f"q{i}" for i in range(30)]
    bench = spark.createDataFrame([(None, " ".join(w[:12])), (None, " ".join(w[:12])), (None, " ".join(w[15:])), (4, " ".join(w[5:20]))], "item_id long, text string")
    r = D.contamination(frame([" ".join(w), "none"]), D.benchmark_blocks(bench)).orderBy("doc_id").collect()
    assert (r[0]["n_hit"], r[0]["n_items"], r[0]["contaminated"]) == (30, 3, True)
    assert r[0]["items_sha256"] == hashlib.sha256(b"4").hexdigest()
    assert (r[1]["n_hit"], r[1]["n_items"], r[1]["contaminated"]) == (0, 0, False)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(frame(["a"]), D.benchmark_blocks(none)).first()["contaminated"] is False
    assert D.contamination(frame([]), D.benchmark_blocks(none)).collect() == []


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = queries.op6_decontaminate(spark, data).orderBy("doc_id").collect()
    got = [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows]
    assert got == brute([d["text"] for d in docs], items)
    assert any(g[4] for g in got)
