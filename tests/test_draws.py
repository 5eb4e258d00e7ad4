"""Draws of equal depth against exact moments, closed forms against enumeration of all draws."""

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions.scalars import log_factorial, log_falling
from tallyfield.operators import diversity
from tallyfield.operators import draws as D


def table(seed=1, samples=5, features=30):
    rng = random.Random(seed)
    rows = [(s, f, rng.randrange(1, 40)) for s in range(samples) for f in range(features) if rng.random() < 0.6]
    rows += [(0, 99, 700), (samples, 100, 29), (samples + 1, 100, 31), (samples + 2, 5, 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample long, feature long, reads long")


def totals(rows):
    out = {}
    for s, _, n in rows:
        out[s] = out.get(s, 0) + n
    return out


@pytest.mark.parametrize("limit", [10**9, 40])
def test_split_has_the_exact_moments(monkeypatch, limit):
    monkeypatch.setattr(D, "_LIMIT", limit)
    sizes = np.array([1, 5, 0, 30, 200, 7, 1, 64])
    n, m, draws = int(sizes.sum()), 50, 3000
    draw, cell, k = D.split(sizes, np.full(draws, m), np.random.default_rng(3))
    table = np.zeros((draws, len(sizes)))
    table[draw, cell] = k
    assert (table.sum(1) == m).all() and (table <= sizes).all()
    p = sizes / n
    cov = m * (n - m) / (n - 1) * (np.diag(p) - np.outer(p, p))
    assert np.abs(table.mean(0) - m * p).max() < 5 * np.sqrt(cov.max() / draws)
    np.testing.assert_allclose(np.cov(table.T), cov, atol=0.1 * cov.max())


def test_split_edges():
    rng = np.random.default_rng(0)
    for sizes in ([3], [3, 4], [1] * 9):
        total = sum(sizes)
        draw, cell, k = D.split(np.array(sizes), np.array([0, total, 1]), rng)
        assert k[draw == 1].tolist() == sizes and k[draw == 2].tolist() == [1] and not (draw == 0).any()
    big = np.array([3 * 10**9, 5 * 10**9, 10])  # beyond the library's populations
    draw, cell, k = D.split(big, np.full(200, 1000), rng)
    share = k[cell == 0].sum() / 200_000
    assert abs(share - 3 / 8) < 5 * math.sqrt(3 / 8 * 5 / 8 / 200_000)


@pytest.mark.parametrize("m,marks", [(50, 1 << 20), (50, 1), (290, 1000), (0, 1000), (308, 1000)])
def test_picked_units_have_the_exact_moments(monkeypatch, m, marks):
    monkeypatch.setattr(D, "_MARKS", marks)
    sizes = np.array([1, 5, 0, 30, 200, 7, 1, 64])
    n, draws = int(sizes.sum()), 3000
    table = D.pick(sizes, np.full(draws, m), np.random.default_rng(3))
    assert (table.sum(1) == m).all() and (table <= sizes).all() and (table >= 0).all()
    p = sizes / n
    cov = m * (n - m) / (n - 1) * (np.diag(p) - np.outer(p, p))
    assert np.abs(table.mean(0) - m * p).max() <= 5 * np.sqrt(cov.max() / draws) + 1e-9
    np.testing.assert_allclose(np.cov(table.T), cov, atol=0.1 * cov.max() + 1e-9)


def test_units_are_picked_where_that_is_less_work(monkeypatch):
    monkeypatch.setattr(D, "split", None)  # a leaf of few reads for its cells needs no tree
    sizes = np.arange(1, 51)
    takes = np.array([100, 0, 1275, 1200, 1])
    assert D.numbers(sizes, takes, np.random.default_rng(1)).sum(1).tolist() == takes.tolist()
    monkeypatch.undo()
    monkeypatch.setattr(D, "pick", None)  # of few cells with many reads none is listed
    assert D.numbers(np.array([10**6, 2 * 10**6]), np.array([900_000, 5]), np.random.default_rng(1)).sum(1).tolist() == [900_000, 5]


@pytest.mark.parametrize("leaf", [4096, 7])
def test_draws_of_a_table(spark, monkeypatch, leaf):
    monkeypatch.setattr(D, "LEAF_CELLS", leaf)
    rows = table()
    df = frame(spark, rows)
    got = D.rarefy(df, 30, 150, 5).collect()
    reads = {(s, f): n for s, f, n in rows}
    per = {}
    for r in got:
        assert 0 < r["reads"] <= reads[r["sample"], r["feature"]]
        per[r["sample"], r["iter"]] = per.get((r["sample"], r["iter"]), 0) + r["reads"]
    deep = {s for s, n in totals(rows).items() if n >= 30}
    assert per == {(s, i): 30 for s in deep for i in range(150)}
    assert len(got) == len({(r["sample"], r["iter"], r["feature"]) for r in got})
    again = D.rarefy(df.repartition(3), 30, 150, 5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    # moments of the same draws, and of the cells
    sums = {}
    for r in got:
        sums[r["sample"], r["feature"]] = sums.get((r["sample"], r["feature"]), 0) + r["reads"]
    drawn = {(r["sample"], r["feature"]): r for r in D.drawn_moments(df, 30, 150, 5).collect()}
    exact = {(r["sample"], r["feature"]): r for r in D.expected_moments(df, 30).collect()}
    assert drawn.keys() == exact.keys() == {(s, f) for s, f, n in rows if s in deep and n}
    for key, r in drawn.items():
        assert r["mean"] == pytest.approx(sums.get(key, 0) / 150)
        assert abs(r["mean"] - exact[key]["expected"]) <= 6 * math.sqrt(exact[key]["variance"] / 150) + 1e-9
    # indices of every draw
    listed = diversity.alpha_diversity(spark.createDataFrame(got), ("iter", "sample")).collect()
    summed = {(r["sample"], r["iter"]): r for r in D.drawn_alpha(df, 30, 150, 5).collect()}
    for r in listed:
        for m in D.MEASURES:
            assert summed[r["sample"], r["iter"]][m] == (None if r[m] is None else pytest.approx(r[m]))


def test_expectations_are_the_means_of_all_draws(spark):
    cells = {1: [("a", 3), ("b", 1), ("c", 4)], 2: [("a", 2), ("c", 5), ("d", 1)], 3: [("d", 4)], 4: [("a", 3)]}
    m = 4
    df = spark.createDataFrame([(s, f, n) for s, c in cells.items() for f, n in c], "sample int, feature string, reads int")

    def every(s, k):
        reads = [f for f, n in cells[s] for _ in range(n)]
        return [{f: c.count(f) for f in set(c)} for c in (list(x) for x in combinations(reads, k))]

    alpha = {r["sample"]: r for r in D.expected_alpha(df, m).collect()}
    assert alpha.keys() == {1, 2, 3}
    for s, r in alpha.items():
        all_ = every(s, m)
        mean = lambda f: sum(map(f, all_)) / len(all_)
        assert r["sobs"] == pytest.approx(mean(len))
        assert r["coverage"] == pytest.approx(mean(lambda d: 1 - sum(k == 1 for k in d.values()) / m))
        assert r["shannon"] == pytest.approx(mean(lambda d: -sum(k / m * math.log(k / m) for k in d.values())), abs=1e-12)
    curve = {(r["sample"], r["depth"]): r["features"] for r in D.expected_curve(df, 3).collect()}
    assert curve.keys() == {(1, 3), (1, 6), (1, 8), (2, 3), (2, 6), (2, 8), (3, 3), (3, 4), (4, 3)}
    for (s, k), v in curve.items():
        all_ = every(s, k)
        assert v == pytest.approx(sum(map(len, all_)) / len(all_))
    beta = {(r["a"], r["b"]): r["dist"] for r in D.expected_beta(df, m, block_size=2).collect()}
    assert beta.keys() == {(1, 2), (1, 3), (2, 3)}
    for (a, b), v in beta.items():
        x, y = every(a, m), every(b, m)
        mean = sum(1 - sum(min(k, q.get(f, 0)) for f, k in p.items()) / m for p in x for q in y) / len(x) / len(y)
        assert v == pytest.approx(mean)


def test_means_of_draws_come_near(spark):
    df = frame(spark, table(4))
    rows = {(r["sample"], r["method"]): r for r in D.alpha_subsampled(df, 30, 400, 2).collect()}
    for r in D.expected_alpha(df, 30).collect():
        ave, std = rows[r["sample"], "ave"], rows[r["sample"], "std"]
        for m in ("coverage", "shannon", "sobs"):
            assert abs(ave[m] - r[m]) <= 5 * std[m] / 20 + 1e-9


def test_empty_and_shallow(spark):
    for rows in ([], [(1, 1, 3)]):
        df = frame(spark, rows)
        for out in (D.rarefy(df, 5, 2), D.drawn_moments(df, 5, 2), D.alpha_subsampled(df, 5, 2), D.expected_alpha(df, 5), D.expected_beta(df, 5)):
            assert out.collect() == []
    assert D.expected_curve(frame(spark, []), 5).collect() == []


def test_log_factorials(spark):
    cases = [(a, n) for a in (0, 1, 7, 15, 16, 17, 40, 1000, 10**6, 10**9) for n in (0, 1, 2, 5, 15, 16, 30, 999) if n <= a]
    df = spark.createDataFrame(cases, "a long, n long")
    for r in df.withColumn("f", log_factorial(F.col("a"))).withColumn("d", log_falling(F.col("a"), F.col("n"))).collect():
        assert r["f"] == pytest.approx(math.lgamma(r["a"] + 1), rel=1e-13, abs=1e-13)
        want = math.fsum(math.log(r["a"] - i) for i in range(r["n"]))
        assert r["d"] == pytest.approx(want, rel=1e-13, abs=1e-12)


@pytest.mark.parametrize("margin", [12, -3])
def test_keyed_draws_list_the_reads_of_the_smallest_keys(spark, monkeypatch, margin):
    monkeypatch.setattr(D, "_MARGIN", margin)  # below zero all draws are made from all reads
    rows = [*table(7), (0, None, 12), (None, 3, 90)]
    want = {}
    for s, total in totals(rows).items():
        for i in range(3 if s is not None and total >= 30 else 0):
            reads = [(f, n) for t, f, k in rows if t == s for n in range(1, k + 1)]
            keyed = sorted((hashlib.md5(f"9-{i}-{s}-{'' if f is None else f}-{n}".encode()).hexdigest(), f) for f, n in reads)
            for _, f in keyed[:30]:
                want[i, s, f] = want.get((i, s, f), 0) + 1
    got = D.keyed_draws(frame(spark, rows), 30, 3, 9).collect()
    assert {(r["iter"], r["sample"], r["feature"]): r["reads"] for r in got} == want and len(got) == len(want)


def test_rarefied_numbers_are_part_of_the_result(spark, data):
    import __spark_entry__ as entry

    rows = entry.queries()["rarefy_depth"](spark, data).collect()
    totals = {}
    for r in rows:
        for i in range(2):
            assert r[f"drawn_{i}"] <= r["reads"]
            totals[r["sample"], i] = totals.get((r["sample"], i), 0) + r[f"drawn_{i}"]
    assert totals and set(totals.values()) == {1000}


def test_keys_of_reads_are_their_md5():
    names = [b"9-0-1-2-", b"9-0-1-", b"x" * 60 + b"-", b"9-1-123456789-987654321-"]
    reads = np.array([1200, 3, 12, 11])
    got = [(int(c), int(h) << 64 | int(x)) for cell, high, low in D._read_keys(names, reads) for c, h, x in zip(cell, high, low)]
    want = [(c, int(hashlib.md5(n + str(i).encode()).hexdigest(), 16)) for c, n in enumerate(names) for i in range(1, reads[c] + 1)]
    assert got == want


@pytest.mark.parametrize("ordered", [1 << 21, 100])
def test_curve_is_that_of_all_reads_in_order(spark, monkeypatch, ordered):
    monkeypatch.setattr(D, "_ORDERED", ordered)  # samples of over 100 reads go by rows
    rows = [*table(7), (0, None, 12), (None, 3, 90)]
    want = {}
    for s, total in totals(rows).items():
        for i in range(2 if s is not None else 0):
            reads = [(f, n) for t, f, k in rows if t == s for n in range(1, k + 1)]
            keyed = sorted((hashlib.md5(f"9-{i}-{s}-{'' if f is None else f}-{n}".encode()).hexdigest(), f) for f, n in reads)
            for depth in {*range(40, total + 1, 40), *([total] if total else [])}:
                want[s, depth] = want.get((s, depth), 0) + len({f for _, f in keyed[:depth]}) / 2
    got = D.keyed_curve(frame(spark, rows), 40, 2, 9).collect()
    assert {(r["sample"], r["depth"]): r["features"] for r in got} == want and len(got) == len(want)


def test_drawn_curve_is_part_of_the_result(spark, data):
    import __spark_entry__ as entry

    rows = entry.queries()["rarefaction_curve"](spark, data).collect()
    deepest = {}
    for r in rows:
        assert abs(r["features"] - r["expected"]) < 40
        deepest[r["sample"]] = max(deepest.get(r["sample"], (0,)), (r["depth"], r["features"], r["expected"]))
    assert deepest and all(f == pytest.approx(e) for _, f, e in deepest.values())


@pytest.mark.parametrize("leaf", [4096, 7])
def test_keys_of_draws_are_not_stored(spark, monkeypatch, leaf):
    monkeypatch.setattr(D, "LEAF_CELLS", leaf)
    stored = []
    monkeypatch.setattr(D, "checkpointed", lambda df: stored.append(df.columns) or df)
    rows = table(7)
    got = D.keyed_draws(frame(spark, rows), 30, 2, 9).collect()
    assert not any("key" in c for c in stored)
    per = {}
    for r in got:
        per[r["iter"], r["sample"]] = per.get((r["iter"], r["sample"]), 0) + r["reads"]
    assert set(per.values()) == {30}
    one = {(r["iter"], r["sample"], r["feature"]): r["reads"] for r in got}
    monkeypatch.setattr(D, "LEAF_CELLS", 4096)
    assert one == {(r["iter"], r["sample"], r["feature"]): r["reads"] for r in D.keyed_draws(frame(spark, rows), 30, 2, 9).collect()}
