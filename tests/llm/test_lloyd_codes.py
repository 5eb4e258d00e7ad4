"""Codes against plain Lloyd rounds over Python integers."""

import math
import random

import numpy as np
import pytest

from tallyfield.llm import lloyd_codes as L
from tallyfield.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, stat double, error string, vec int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """``rows`` of (vec_id, vector, label); results in the order of the kept rows, and the codebooks."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-longest // parts)
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    ints = [[math.floor(scale * c) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    codes = [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in assign()]
    total = {}
    for (_, _, x), (_, e) in zip(kept, codes):
        total[x] = total.get(x, 0) + e
    return [(i, c, e, total[x]) for (i, _, x), (c, e) in zip(kept, codes)], books


def run(df, **kw):
    coded, books = L.compress(df, **kw)
    rows = L.label_errors(coded).collect()
    return sorted((str(r["vec_id"]), bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in rows), books


def same(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 0.5, "y", 3) for r in rows], SCHEMA)
    got, books = run(df.repartition(3), **kw)
    want, plain = brute(rows, **kw)
    assert got == sorted((str(i), *x) for i, *x in want)
    assert books.tolist() == plain or not want


def test_random_and_coarse(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([0, 1, None])) for i in range(300)]
    rows = [(i, [float(np.float32(c)) for c in v], x) for i, v, x in rows]
    same(spark, rows)
    # ties between entries and repeated rows, below zero too
    rows = [(rng.randrange(90), [rng.randrange(-2, 3) / 4096 for _ in range(8)], 1) for _ in range(200)]
    same(spark, rows, entries=5)


def test_odd_rows(spark):
    good = [float(x) for x in range(8)]
    rows = [
        (1, None, 1), (2, [1.0, None] * 4, 1), (3, [math.nan] + good[1:], 1), (4, good[1:] + [math.inf], 2), (5, [], None),
        (6, good, None), (6, good, None), (6, good[::-1], 2), (None, good, 1), (None, [-0.5, -0.0001], 3), (9, good + [7.0], 1),
    ]
    same(spark, rows)
    same(spark, rows[:4])
    same(spark, [])
    same(spark, rows[:5])
    with pytest.raises(Exception, match="component is beyond"):
        run(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<float>, label int"))


def test_moved_entries_only():
    rng = np.random.default_rng(5)
    x = rng.integers(-6, 7, (4000, 2))
    book = rng.integers(-6, 7, (12, 2))
    code, dist = L.nearest(x, book)
    for moves in (0, 1, 3, 12):
        moved = np.zeros(12, bool)
        moved[rng.choice(12, moves, replace=False)] = True
        book[moved] += rng.integers(-1, 2, (moves, 2))
        cost = L.reassign(x, book, moved, code, dist)
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == every.argmin(1)).all() and (dist == every.min(1)).all()
        assert cost <= x.shape[0] * 12 and (moves > 3 or cost < x.shape[0] * 12 / 2)


def test_query(spark, data):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, _ = brute(rows)
    got = queries.op12_lloyd_codes(spark, data).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted(want)
