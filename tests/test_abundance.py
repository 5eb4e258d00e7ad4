"""Differential abundance against dense linear algebra on small fixtures."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import abundance as A


@pytest.fixture(scope="module")
def trial(spark):
    rng = random.Random(2)
    samples = [(i, ["ctl", "gos"][i % 2], ["unc", "sal"][(i // 2) % 2], [22, 24, 28, 35][(i // 4) % 4]) for i in range(24)]
    cells = [(s[0], f, rng.randrange(1, 80)) for s in samples for f in range(7) if rng.random() < 0.7]
    s = spark.createDataFrame(samples, "sample long, diet string, challenge string, age int")
    return s, spark.createDataFrame(cells, "sample long, feature long, reads long"), samples, cells


def dense(samples, cells, features=7):
    m = np.zeros((len(samples), features))
    for s, f, n in cells:
        m[s, f] = n
    x = np.array([[1.0, c == "sal", d == "gos", a] for _, d, c, a in samples], float)
    return m, x


def test_reference_levels_ignore_case(trial):
    s, *_ = trial
    assert A.trial_design(s).columns == ["sample", "intercept", "challengeSE", "dietgos", "age"]


def test_clr_sums_to_zero_with_absent_cells(trial):
    s, c, samples, cells = trial
    rows = A.clr_transform(c, s).collect()
    for sample, *_ in samples:
        mine = [r for r in rows if r["sample"] == sample]
        assert sum(r["clr"] for r in mine) + (7 - len(mine)) * mine[0]["absent"] == pytest.approx(0, abs=1e-9)


def test_sparse_glm_equals_dense_least_squares(trial):
    s, c, samples, cells = trial
    m, x = dense(samples, cells)
    y = np.log(m + 0.5)
    y = y - y.mean(axis=1, keepdims=True)
    got = {(r["feature"], r["term"]): r for r in A.clr_glm(c, s, A.trial_design(s)).collect()}
    inv = np.linalg.inv(x.T @ x)
    for f in range(7):
        b = inv @ x.T @ y[:, f]
        s2 = np.sum((y[:, f] - x @ b) ** 2) / (len(samples) - 4)
        for j, t in enumerate(A.TERMS):
            assert got[(f, t)]["estimate"] == pytest.approx(b[j], abs=1e-9)
            assert got[(f, t)]["se"] == pytest.approx(np.sqrt(s2 * inv[j, j]), abs=1e-9)
            assert got[(f, t)]["p_adj"] >= got[(f, t)]["p_value"] - 1e-12


def test_instances_are_reproducible_and_centred(trial):
    s, c, *_ = trial
    one = {(r["sample"], r["feature"]): r["clr"] for r in A.dirichlet_clr_instances(c, s, 16, seed=3).collect()}
    two = {(r["sample"], r["feature"]): r["clr"] for r in A.dirichlet_clr_instances(c.repartition(7), s, 16, 3).collect()}
    assert one.keys() == two.keys() and len(one) == 24 * 7
    for k in one:
        np.testing.assert_allclose(one[k], two[k], atol=1e-9)
    for sample in range(24):
        np.testing.assert_allclose(np.sum([one[(sample, f)] for f in range(7)], axis=0), 0, atol=1e-9)


def test_instance_model_is_near_the_direct_model(trial):
    s, c, samples, cells = trial
    direct = {(r["feature"], r["term"]): r["estimate"] for r in A.clr_glm(c, s, A.trial_design(s)).collect()}
    inst = A.dirichlet_clr_instances(c.selectExpr("sample", "feature", "reads * 1000 AS reads"), s, 8, 1)
    rows = A.glm_over_instances(inst, A.trial_design(s)).collect()
    assert len(rows) == 28 and all(0 <= r["p_adj"] <= 1 for r in rows)
    assert direct.keys() == {(r["feature"], r["term"]) for r in rows}


def test_effect_size_finds_a_shift(spark, trial):
    s, c, samples, cells = trial
    boost = [(a, f, n * (50 if f == 3 and samples[a][2] == "sal" else 1)) for a, f, n in cells]
    boosted = spark.createDataFrame(boost, "sample long, feature long, reads long")
    found = A.feature_effect_size(A.dirichlet_clr_instances(boosted, s, 32, 1), A.trial_design(s)).collect()
    assert {r["term"] for r in found} == {"challengeSE", "dietgos"}
    rows = {r["feature"]: r for r in found if r["term"] == "challengeSE"}
    # the difference has the sign of the model's estimate: challenged minus mock
    assert max(rows, key=lambda f: rows[f]["diff_btw"]) == 3 and rows[3]["diff_btw"] > 0
    assert all(0 <= r["overlap"] <= 0.5 for r in rows.values())


def _effects_at_once(va, vb, seed):
    rng = np.random.default_rng(seed)
    size = max(len(va), len(vb))
    pick = lambda v: rng.choice(v, size)
    between = pick(vb) - pick(va)
    within = np.maximum(np.abs(pick(va) - pick(va)), np.abs(pick(vb) - pick(vb)))
    with np.errstate(all="ignore"):
        ratio = between / within
    return np.median(between), np.median(within), np.nanmedian(ratio), min((between < 0).mean(), (between > 0).mean())


@pytest.mark.parametrize("shape", [(40, 40, 16), (7, 3, 5), (1, 2, 1), (3, 0, 4), (5, 6, None)])
def test_effects_in_blocks_are_those_at_once(monkeypatch, shape):
    monkeypatch.setattr(A, "_PICKS", 13)
    rng = np.random.default_rng(2)
    sizes = [np.full(n, shape[2]) if shape[2] else rng.integers(0, 9, n) for n in shape[:2]]
    parts = [rng.normal(i, 1, int(k.sum())).round(1) for i, k in enumerate(sizes)]
    values = np.concatenate(parts)
    groups = [A._Group(values, np.cumsum(k) - k + at, k) for k, at in zip(sizes, (0, len(parts[0])))]
    want = _effects_at_once(*(p if len(p) else np.array([np.nan]) for p in parts), 5)
    np.testing.assert_array_equal(A.effect_sizes(*groups, 5), want)


def test_effects_hold_no_array_of_their_picks(monkeypatch):
    monkeypatch.setattr(A, "_PICKS", 1 << 14)
    values, k = np.random.default_rng(1).normal(0, 1, 1_000_000), np.full(500, 1000)
    groups = [A._Group(values, np.cumsum(k) - k + at, k) for at in (0, 500_000)]
    tracemalloc.start()
    got = A.effect_sizes(*groups, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_array_equal(got, _effects_at_once(values[:500_000], values[500_000:], 5))
    assert peak < values.nbytes  # of six streams of half a million, and the arrays made of them


def test_effect_sizes_of_features_are_those_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f, rng.normal(0, 1, 6).tolist()) for s in range(9) for f in ("a", "b", None) if rng.random() < 0.9]
    design = spark.createDataFrame([(s, 1.0, float(s % 2), s / 3) for s in range(9)], "sample long, intercept double, odd double, age double")
    inst = spark.createDataFrame(rows, "sample long, feature string, clr array<double>").repartition(5)
    got = {r["feature"]: tuple(r)[1:] for r in A.feature_effect_size(inst, design, 3).collect()}
    assert set(got) == {"a", "b", None}
    for f, (term, *found) in got.items():
        va, vb = (np.concatenate([c for s, g, c in rows if g == f and s % 2 == lv]) for lv in (0, 1))
        assert term == "odd"
        np.testing.assert_array_equal(found, _effects_at_once(va, vb, 3))


def test_bias_corrected_model_recovers_a_known_effect(spark):
    rng = np.random.default_rng(3)
    samples = [(i, ["ctl", "gos"][i % 2], ["unc", "sal"][(i // 2) % 2], [22, 24, 28, 35][(i // 4) % 4]) for i in range(32)]
    depth = rng.normal(0, 1, 32)  # sample bias the model has to remove
    cells = []
    for f in range(40):
        base = rng.normal(6, 0.5)
        for i, d, ch, a in samples:
            effect = 2.0 if f < 4 and ch == "sal" else 0.0
            cells.append((i, f, int(np.exp(base + effect + depth[i] + rng.normal(0, 0.2)))))
    s = spark.createDataFrame(samples, "sample long, diet string, challenge string, age int")
    c = spark.createDataFrame(cells, "sample long, feature long, reads long").where("reads > 0")
    res, frac = A.bias_corrected_glm(c, A.trial_design(s))
    rows = {(r["feature"], r["term"]): r for r in res.collect()}
    for f in range(40):
        r = rows[(f, "challengeSE")]
        assert r["lfc"] == pytest.approx(2.0 if f < 4 else 0.0, abs=0.35)
        assert r["diff"] == (f < 4)
    got = np.array([r["samp_frac"] for r in frac.orderBy("sample").collect()])
    assert np.corrcoef(got, depth)[0, 1] > 0.95


def test_structural_zeros(spark, trial):
    s, _, samples, _ = trial
    only = [(a, 1, 5) for a, _, ch, _ in samples if ch == "sal"] + [(0, 2, 1)]
    c = spark.createDataFrame(only, "sample long, feature long, reads long")
    rows = {(r["feature"], r["level"]): r["zero"] for r in A.structural_zeros(c, s, "challenge").collect()}
    assert rows == {(1, "sal"): False, (1, "unc"): True, (2, "sal"): True, (2, "unc"): True}


def test_association_counts_zeros_as_ties(spark, trial):
    s, c, samples, cells = trial
    m, _ = dense(samples, cells)
    rng = random.Random(6)
    val = [rng.randrange(50) for _ in samples]
    an = spark.createDataFrame([(i, "acid", float(v)) for i, v in enumerate(val) if i != 5], "sample long, analyte string, value double")
    x = c.selectExpr("sample", "feature", "CAST(reads AS DOUBLE) AS x")
    rows = A.feature_analyte_correlation(x, s, an, "diet").collect()
    rank = lambda v: np.array([sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v])
    for r in rows:
        idx = [i for i, (_, d, *_) in enumerate(samples) if d == r["stratum"] and i != 5]
        want = np.corrcoef(rank(m[idx, r["feature"]]), rank([val[i] for i in idx]))[0, 1]
        assert r["n"] == len(idx) and r["estimate"] == pytest.approx(want)


def test_association_of_signed_values(spark):
    rng = random.Random(9)
    n = 24
    s = spark.createDataFrame([(i, "a") for i in range(n)], "sample long, diet string")
    val = [float(rng.randrange(8)) for _ in range(n)]
    an = spark.createDataFrame([(i, "acid", v) for i, v in enumerate(val)] + [(3, "salt", float("nan")), (3, "salt", None)],
                               "sample long, analyte string, value double")
    x = {f: [rng.choice([-2.5, -1.0, 0.0, 0.0, 1.0, 3.0]) for _ in range(n)] for f in range(6)}
    x[6] = [float(i - n // 2) for i in range(n)]
    x[7] = [-abs(v) for v in x[0]]
    cells = spark.createDataFrame(
        # every second zero is stored
        [(i, f, v) for f, vs in x.items() for i, v in enumerate(vs) if v or i % 2], "sample long, feature long, x double"
    )
    rows = A.feature_analyte_correlation(cells, s, an, "diet").collect()
    rank = lambda v: np.array([sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v])
    assert {r["feature"] for r in rows} == set(x) and {r["analyte"] for r in rows} == {"acid"}
    for r in rows:
        assert r["estimate"] == pytest.approx(np.corrcoef(rank(x[r["feature"]]), rank(val))[0, 1])
    p = sorted((r["p_value"], r["q"]) for r in rows)
    for k, (_, q) in enumerate(p):
        assert q == pytest.approx(min(1.0, *(p[j][0] * len(p) / (j + 1) for j in range(k, len(p)))))


def test_directional_contrasts_of_a_full_model(spark):
    rng = np.random.default_rng(8)
    groups, sexes = np.array(["a", "B", "c"]), np.array(["f", "m"])
    samples = [(i, str(groups[i % 3]), str(sexes[(i // 3) % 2]), float(rng.normal())) for i in range(42)]
    lam = np.exp(rng.normal(2, 1, 12))[None, :] * np.ones((42, 1))
    lam[[s[1] == "c" for s in samples], :3] *= 6  # three features differ
    n = rng.poisson(lam)
    counts = [(i, j, int(n[i, j])) for i in range(42) for j in range(12) if n[i, j]]
    s = spark.createDataFrame(samples, "sample int, g string, sex string, x double")
    c = spark.createDataFrame(counts, "sample int, feature int, reads long")
    got = {(r["feature"], r["contrast"]): r for r in A.group_contrasts(c, s, "g", ["sex"], ["x"], alpha=0.05).collect()}
    logs = np.log(n + 0.5)
    y = logs - logs.mean(1, keepdims=True)
    g = np.array([r[1] for r in samples])
    x = np.column_stack([np.ones(42), g == "B", g == "c", [r[2] == "m" for r in samples], [r[3] for r in samples]]).astype(float)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    rss = ((y - x @ beta) ** 2).sum(0)
    small = np.linalg.lstsq(x[:, [0, 3, 4]], y, rcond=None)[0]
    rss0 = ((y - x[:, [0, 3, 4]] @ small) ** 2).sum(0)
    p = np.array([float(A.tails.f_sf(v, 2, 37)) for v in (rss0 - rss) / 2 / (rss / 37)])
    order = np.argsort(p)
    q = np.empty(12)
    q[order] = np.minimum(1, np.minimum.accumulate((p[order] * 12 / np.arange(1, 13))[::-1])[::-1])
    for j in range(12):
        tests = []
        for name, w in (("B - a", [0, 1, 0, 0, 0]), ("c - a", [0, 0, 1, 0, 0]), ("c - B", [0, -1, 1, 0, 0])):
            w = np.array(w, float)
            est, se = w @ beta[:, j], np.sqrt(rss[j] / 37 * (w @ inv @ w))
            tests.append((float(A.tails.t_two_sided(est / se, 37)), name, est, se))
        run = 0.0
        for k, (pv, name, est, se) in enumerate(sorted(tests)):
            run = max(run, (3 - k) * pv)
            r = got[j, name]
            assert r["estimate"] == pytest.approx(est) and r["se"] == pytest.approx(se)
            assert r["p_adj"] == pytest.approx(min(1, run)) and r["global_p"] == pytest.approx(p[j]) and r["global_q"] == pytest.approx(q[j])
            sure = q[j] <= 0.05 and min(1, run) <= 0.05 * (q <= 0.05).sum() / 12
            assert r["direction"] == (np.sign(est) if sure else 0)
    assert {r["feature"] for r in got.values() if r["direction"] == 1} >= {0, 1, 2}


def test_association_moves_a_cell_once(spark, monkeypatch):
    # 40 analytes: what is shuffled does not grow with them; a null stratum, analyte or sample counts for none
    rng = random.Random(2)
    s = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)] + [(40, None), (None, "a")], "sample long, diet string")
    x = spark.createDataFrame([(i, f, float(rng.randrange(4))) for i in range(41) for f in range(30)] + [(None, 1, 2.0)],
                              "sample long, feature long, x double")
    an = [(i, f"n{k}", float(rng.randrange(30))) for i in range(41) for k in range(40)]
    an = spark.createDataFrame([*an, *[(i, None, 1.0) for i in range(41)], (None, "n1", 3.0)], "sample long, analyte string, value double")
    seen, adjust = [], A.adjust_bh
    monkeypatch.setattr(A, "adjust_bh", lambda df, *a: seen.append(df) or adjust(df, *a))
    res = A.feature_analyte_correlation(x, s, an, "diet")
    rows = {(r["stratum"], r["analyte"], r["feature"]): r["n"] for r in res.collect()}
    assert set(rows) == {(g, f"n{k}", f) for g in "ab" for k in range(40) for f in range(30)} and set(rows.values()) == {20}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generate = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert any("RepartitionByExpression" in line for line in plan[generate:])  # dealt out before the analytes are


def test_log_model_keeps_cells_with_their_feature(spark):
    s = spark.range(40).selectExpr("id AS sample", "CAST(id % 2 AS DOUBLE) AS g")
    rng = random.Random(4)
    c = spark.createDataFrame([(i, f, 2 + rng.randrange(50)) for i in range(40) for f in range(200)], "sample long, feature long, reads long")
    design = s.selectExpr("sample", "1D AS intercept", "g")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        cells = A._alternate(c, design, 1e-2, 20)[0]
        places = cells.select("feature", F.spark_partition_id().alias("at")).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert places == 200
    assert "Join" not in cells._jdf.queryExecution().optimizedPlan().toString()  # kept ones are written, not found anew in every step


def test_tails_end_with_their_slowest_row(monkeypatch):
    from tallyfield.functions import tails

    steps, away = [], tails._away
    monkeypatch.setattr(tails, "_away", lambda v: steps.append(1) or away(v))
    t = np.append(np.linspace(-5, 5, 1000), np.nan)
    p = tails.t_two_sided(t, np.full(1001, 1500.0))
    assert len(steps) < 4 * 100 and np.isnan(p[-1]) and np.isfinite(p[:-1]).all()
    assert p[0] == pytest.approx(6.43e-7, rel=1e-2)
