"""Prefix hashes against the texts themselves."""

import hashlib
import os.path
import random

from tallyfield.llm import prefix_hash as P
from tallyfield.llm import queries


def common(a, b):
    return len(os.path.commonprefix([a, b]))


def alike(a, b):
    if a == b:
        return 1.0
    head = common(a, b)
    return (head + min(common(a[::-1], b[::-1]), min(len(a), len(b)) - head)) / max(len(a), len(b))


def test_spans_and_extensions():
    rng = random.Random(8)
    for _ in range(60):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 60)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 30)))
        x, y = P.PrefixHash(a), P.PrefixHash(b)
        assert P.likeness(x, y) == alike(a, b)
        assert x.back_extension(y) == common(a[::-1], b[::-1])
        for _ in range(20):
            i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
            assert x.extension(i, y, j) == common(a[i:], b[j:])
            n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
            assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k, t = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        edited = x.replaced_end(k, y, t)
        assert edited.fingerprint() == P.PrefixHash(a[:k] + b[:t]).fingerprint()


def brute(texts, ids):
    rows = sorted(zip(ids, texts), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + follow[:m]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.PrefixHash(t).fingerprint(),
                    P.PrefixHash(edited).fingerprint(), alike(t, edited), alike(t, follow)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_rows(frame):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    texts += [None, "", "same", "same", "x" * 1_200_000, texts[0], "repeat", "other"]
    ids = [7 * i % 1009 for i in range(150)] + [2000, 2001, -5, -6, 3000, -7, 50_000, 50_000]
    got = P.document_fingerprints(frame(texts, ids=ids).repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(texts, ids), key=key)
    for case in ([], ["only"], ["a" * 9, None]):
        got = [tuple(r) for r in P.document_fingerprints(frame(case)).collect()]
        assert sorted(got) == sorted(brute(case, range(len(case))))
    got = [tuple(r) for r in P.document_fingerprints(frame(["abc", "abcdef", "b"], ids=[None, 4, 2])).collect()]
    assert sorted(got, key=key) == sorted(brute(["abc", "abcdef", "b"], [None, 4, 2]), key=key)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op10_prefix_hash(spark, data).collect()]
    assert sorted(got) == sorted(brute([d["text"] for d in docs], [d["doc_id"] for d in docs]))
