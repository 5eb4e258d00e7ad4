"""Ranks, quantiles, adjustment and tests against brute force on small fixtures."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfield.functions import scalars as S
from tallyfield.functions import tails
from tallyfield.operators import adjust, ranks, stats


def skewed(seed=3, n=400):
    """Two strata; one value holds a third of all rows."""
    rng = random.Random(seed)
    return [("ab"[i % 5 == 0], "xyz"[rng.randrange(3)], 7.0 if i % 3 == 0 else float(rng.randrange(-20, 40))) for i in range(n)]


def midranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


@pytest.mark.parametrize("buckets", [2, 9, 64])
def test_rank_table_is_the_same_for_any_cut(spark, buckets):
    rows = skewed()
    df = spark.createDataFrame(rows, "s string, g string, v double")
    got = {(r["s"], r["v"]): r for r in ranks.rank_table(df, ["s"], "v", buckets=buckets).collect()}
    for s in "ab":
        vals = [v for t, _, v in rows if t == s]
        for v, m in zip(vals, midranks(vals)):
            assert got[(s, v)]["midrank"] == m
            assert got[(s, v)]["maxrank"] == sum(w <= v for w in vals)
            assert got[(s, v)]["total"] == len(vals)


def test_row_ranks_sum_and_null(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", None), ("a", -1.0)], "s string, v double")
    got = sorted((r["rank"] is None, r["rank"] or 0) for r in ranks.with_rank(df, ["s"], "v").collect())
    assert got == [(False, 1.0), (False, 2.5), (False, 2.5), (True, 0)]


def test_reserved_column_names(spark):
    with pytest.raises(ValueError):
        ranks.rank_table(spark.createDataFrame([("a", 1.0)], "s string, n double"), ["s"], "n")


def test_quantiles_match_numpy(spark):
    rows = skewed(5)
    df = spark.createDataFrame(rows, "s string, g string, v double")
    got = ranks.quantiles(df, ["s"], "v", {"q1": 0.25, "m": 0.5, "h": 0.975}).collect()
    for r in got:
        vals = [v for t, _, v in rows if t == r["s"]]
        np.testing.assert_allclose([r["q1"], r["m"], r["h"]], np.quantile(vals, [0.25, 0.5, 0.975]))


def bh(p):
    m, order = len(p), np.argsort(p)
    out, best = np.empty(m), 1.0
    for k in range(m - 1, -1, -1):
        best = min(best, p[order[k]] * m / (k + 1))
        out[order[k]] = best
    return out


def holm(p):
    m, order = len(p), np.argsort(p, kind="stable")
    out, best = np.empty(m), 0.0
    for k in range(m):
        best = max(best, min(1.0, (m - k) * p[order[k]]))
        out[order[k]] = best
    return out


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.floats(0, 1), st.sampled_from([0.01, 0.5, 1.0, 1e-12])), min_size=1, max_size=40))
def test_adjustment(spark, ps):
    df = spark.createDataFrame([(i, "s", p) for i, p in enumerate(ps)] + [(-1, "s", None)], "i int, s string, p double")
    for fn, ref in ((adjust.adjust_bh, bh), (adjust.adjust_holm, holm)):
        rows = {r["i"]: r["p_adj"] for r in fn(df, ["s"], "p", materialize=False).collect()}
        assert rows.pop(-1) is None
        np.testing.assert_allclose([rows[i] for i in range(len(ps))], ref(np.array(ps)), atol=1e-12)


def test_adjusted_p_is_monotone_across_ranges(spark):
    rng = np.random.default_rng(1)
    ps = np.concatenate([rng.random(300), rng.random(100) * 1e-6, np.ones(150)])
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i int, p double")
    got = {r["i"]: r["p_adj"] for r in adjust.adjust_bh(df, [], "p", materialize=False).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(ps))], bh(ps), atol=1e-12)


def test_exact_rank_sum_against_enumeration():
    n, m = 3, 4
    ws = [sum(c) - n * (n + 1) // 2 for c in itertools.combinations(range(1, n + m + 1), n)]
    for w in range(n * m + 1):
        lower = sum(x <= w for x in ws) / len(ws)
        upper = sum(x >= w for x in ws) / len(ws)
        want = min(1, 2 * (upper if w > n * m / 2 else lower))
        assert tails.rank_sum_exact(w, n, m) == pytest.approx(want)


def test_exact_spearman_against_permutations():
    n, mid = 5, 5 * 24 / 6
    sums = [sum((i - p) ** 2 for i, p in enumerate(perm)) for perm in itertools.permutations(range(n))]
    for s in sorted(set(sums)):
        rho = 1 - 6 * s / (n * (n * n - 1))
        tail = sum(x >= s for x in sums) if s > mid else sum(x <= s for x in sums)
        assert tails.spearman_p(rho, n, False) == pytest.approx(min(1, 2 * tail / len(sums)))
    # the series used above n = 9 is close to the t approximation at moderate n
    assert tails.spearman_p(0.3, 60, False) == pytest.approx(tails.spearman_p(0.3, 60, True), abs=3e-3)


def test_tails_against_published_critical_values():
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert float(tails.chi2_sf(7.814727903251179, 3)) == pytest.approx(0.05)
    assert float(tails.t_two_sided(2.2281388519649385, 10)) == pytest.approx(0.05)
    assert float(tails.f_sf(4.102821, 2, 10)) == pytest.approx(0.05, abs=1e-6)
    for q, k, df in ((3.877, 3, 10), (3.958, 4, 20), (4.232, 5, 20)):
        assert tails.studentized_range_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)


def test_tails_over_arrays():
    x = np.concatenate([np.linspace(-6, 27, 3001), [0.0, 1e-300, -30, 40]])
    want = np.array([math.erfc(v) for v in x])
    np.testing.assert_allclose(tails.erfc(x), want, rtol=2e-13)
    x = np.concatenate([np.linspace(1e-3, 40, 3001), np.logspace(-12, 12, 200)])
    np.testing.assert_allclose(tails.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=2e-14)
    q = np.array([0.0, -1.0, 0.5, 3.0, 3.958, 9.0, 60.0])
    every = tails.studentized_range_sf(q, 4, 20)
    assert every[:2].tolist() == [1, 1] and every[4] == pytest.approx(0.05, abs=2e-4) and every[-1] < 1e-9
    # two groups: the range is a t variable times the root of two
    np.testing.assert_allclose(tails.studentized_range_sf(q[2:], 2, 17), tails.t_two_sided(q[2:] / math.sqrt(2), 17), atol=1e-9)
    assert tails.studentized_range_sf(3.0, 4, 5e5)[0] == pytest.approx(tails.studentized_range_sf(3.0, 4, 5e6)[0], abs=5e-6)


def test_one_value_has_no_shape(spark):
    df = spark.createDataFrame([("a", 0.1)] * 9 + [("b", float(i)) for i in range(9)], "g string, x double")
    rows = {r["g"]: r for r in stats.shapiro_wilk(df, ["g"], "x").collect()}
    assert rows["a"]["statistic"] is None and rows["a"]["p_value"] is None and rows["a"]["n"] == 9
    assert rows["b"]["statistic"] > 0.9


def test_probit_inverts_the_normal(spark):
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select(tails.probit(F.col("p")).alias("z"))
    zs = [r["z"] for r in df.collect()]
    np.testing.assert_allclose([1 - float(tails.normal_sf(z)) for z in zs], ps, rtol=1e-7)


def test_shapiro_published_example(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "s string, v double")
    rows = {r["s"]: r for r in stats.shapiro_wilk(df, ["s"], "v").collect()}
    assert rows["a"]["statistic"] == pytest.approx(0.79, abs=0.01)
    assert rows["a"]["p_value"] == pytest.approx(0.007, abs=0.004)
    assert rows["b"]["statistic"] is None


def test_shapiro_of_any_size_with_ties(spark):
    from statistics import NormalDist

    def w(xs):
        xs, n = np.sort(np.array(xs)), len(xs)
        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        u, mm = n**-0.5, m @ m
        an = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / mm**0.5], u)
        am = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / mm**0.5], u)
        a = m / np.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * am**2))
        a[[-1, -2, 0, 1]] = an, am, -an, -am
        return (a @ xs) ** 2 / ((xs - xs.mean()) ** 2).sum()

    rng = random.Random(5)
    groups = {"tied": [0.0] * 9000 + [rng.gauss(3, 1) for _ in range(3000)], "odd": [rng.gauss(0, 1) for _ in range(6001)]}
    rows = [(g, v) for g, xs in groups.items() for v in xs] + [("odd", float("nan")), ("odd", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "s string, v double")
    got = {r["s"]: r for r in stats.shapiro_wilk(df, ["s"], "v").collect()}
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs) and got[g]["statistic"] == pytest.approx(w(xs), rel=1e-7)
    assert got["odd"]["p_value"] > 0.001 and got["tied"]["p_value"] < 1e-6
    assert got["two"]["n"] == 2 and got["two"]["statistic"] is None


def test_kruskal_and_dunn_brute_force(spark):
    rows = [("a", g, v) for _, g, v in skewed(9, 90)]
    df = spark.createDataFrame(rows, "s string, g string, v double")
    vals = [v for *_, v in rows]
    rk, n = midranks(vals), len(vals)
    groups = {g: [r for (_, h, _), r in zip(rows, rk) if h == g] for g in "xyz"}
    tie = sum(t**3 - t for t in (vals.count(v) for v in set(vals)))
    h = (12 / (n * (n + 1)) * sum(sum(r) ** 2 / len(r) for r in groups.values()) - 3 * (n + 1)) / (1 - tie / (n**3 - n))
    got = stats.kruskal_wallis(df, ["s"], "v", "g").first()
    assert got["statistic"] == pytest.approx(h) and got["df"] == 2
    assert got["p_value"] == pytest.approx(math.exp(-h / 2))
    pairs = {r["comparison"]: r for r in stats.dunn_test(df, ["s"], "v", "g").collect()}
    var = (n * (n + 1) / 12 - tie / (12 * (n - 1))) * (1 / len(groups["x"]) + 1 / len(groups["z"]))
    z = (np.mean(groups["x"]) - np.mean(groups["z"])) / math.sqrt(var)
    assert pairs["x - z"]["statistic"] == pytest.approx(z)
    assert len(pairs) == 3 and all(r["p_adj"] >= r["p_value"] - 1e-12 for r in pairs.values())


def test_level_order_ignores_case(spark):
    df = spark.createDataFrame([("SE", 1), ("mock", 2)], "g string, size int")
    r = stats.level_pairs(df, [], "g", ["size"]).first()
    assert (r["level_a"], r["level_b"]) == ("mock", "SE")


def test_pairwise_orientation_and_exact_path(spark):
    rows = [("s", g, float(v)) for g, vs in (("control", [1, 2, 3, 4, 5]), ("GOS", [6, 7, 8, 9, 10])) for v in vs]
    df = spark.createDataFrame(rows, "s string, g string, v double")
    r = stats.pairwise_wilcoxon(df, ["s"], "v", "g").first()
    assert (r["group1"], r["group2"], r["statistic"]) == ("GOS", "control", 25.0)
    assert r["p_value"] == pytest.approx(2 / math.comb(10, 5))
    assert stats.pairwise_wilcoxon(df, ["s"], "v", "g", gate=1e-6).count() == 0


def test_unbalanced_anova_against_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = [("s", "pq"[i % 2], "uvw"[(i * i) % 3], float(rng.normal() + i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "s string, a string, b string, v double")
    got = {r["term"]: r for r in stats.anova_two_way(df, ["s"], "v", "a", "b").collect()}
    y = np.array([r[3] for r in rows])
    one = np.ones(60)
    a = [np.array([r[1] == "q" for r in rows], float)]
    b = [np.array([r[2] == lv for r in rows], float) for lv in "vw"]
    ab = [p * q for p in a for q in b]

    def rss(cols):
        x = np.column_stack([one, *cols])
        return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))

    steps = [rss([]), rss(a), rss(a + b), rss(a + b + ab)]
    for term, ss in zip(("a", "b", "a:b"), -np.diff(steps)):
        assert got[term]["sum_sq"] == pytest.approx(ss, abs=1e-8)
    assert got["Residuals"]["sum_sq"] == pytest.approx(steps[-1])
    assert got["Residuals"]["p_value"] is None


def test_scalar_conventions(spark):
    df = spark.createDataFrame([("Otu0007", 0.0), (None, 123456.0), ("AACCCT-", 0.012345)], "x string, v double")
    r = df.select(
        S.paste("x", F.lit("k"), sep="_").alias("p"), S.str_replace_first(F.col("x"), "00").alias("r"),
        S.signif(F.col("v"), 3).alias("s"), S.log_or_limit(F.col("v")).alias("l"), S.numeric_id(F.col("x")).alias("i"),
        S.longest_run(F.col("x")).alias("h"), S.last_base(F.col("x")).alias("e"),
    ).collect()
    assert [x["p"] for x in r] == ["Otu0007_k", "NA_k", "AACCCT-_k"]
    assert r[0]["r"] == "Otu07" and r[0]["i"] == 7 and r[0]["l"] == float("-inf")
    assert [x["s"] for x in r] == [0.0, 123000.0, 0.0123]
    assert r[2]["h"] == 3 and r[2]["e"] == 6
    assert S.syntactic_name("2nd pen") == "X2nd.pen"
