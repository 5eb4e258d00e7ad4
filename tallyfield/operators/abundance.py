"""Compositional differential abundance on sparse long counts.

Absent cells are zeros. Their share of every sum is added arithmetically (a constant per sample), so
linear models over 10^6 features touch stored cells only. Matrices that reach the driver are
model-sized (a few terms square).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import tails
from ..session import BROADCAST_BYTES, broadcast_if_small, checkpointed
from .adjust import adjust_bh, adjust_holm
from .ranks import join_null_safe, quantiles, window_ranks
from .stats import usable

TERMS = ("intercept", "challengeSE", "dietgos", "age")


# ---------------------------------------------------------------- design


def level_list(samples: DataFrame, factor: str) -> list[str]:
    """Factor levels in case-insensitive order; the first is the reference. Design-bounded."""
    rows = samples.select(factor).distinct().collect()
    return sorted((r[0] for r in rows), key=lambda v: (str(v).lower(), str(v)))


def design_matrix(samples: DataFrame, factors: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Treatment-coded design: intercept, one 0/1 column per non-reference level, numeric columns."""
    cols = [F.lit(1.0).alias("intercept")]
    for f in factors:
        for lv in level_list(samples, f)[1:]:
            cols.append((F.col(f) == lv).cast("double").alias(f"{f}{lv}"))
    cols += [F.col(c).cast("double").alias(c) for c in numeric]
    return samples.select("sample", *cols)


def trial_design(samples: DataFrame) -> DataFrame:
    """``~ challenge + diet + age`` with mock and ctl as reference levels."""
    named = samples.withColumn("challenge", S.challenge_label(F.col("challenge")))
    return design_matrix(named, ["challenge", "diet"], ["age"])


# ---------------------------------------------------------------- CLR


def clr_centers(counts: DataFrame, samples: DataFrame, n_features: int, offset: float = 0.5) -> DataFrame:
    """``(sample, center, absent)``: mean log over all features, and the value of an absent cell."""
    part = counts.groupBy("sample").agg(
        F.sum(F.log(F.col("reads") + offset)).alias("_s"), F.count("*").alias("_k")
    )
    log0 = F.log(F.lit(float(offset)))
    center = (F.coalesce("_s", F.lit(0.0)) + (n_features - F.coalesce("_k", F.lit(0))) * log0) / n_features
    return samples.select("sample").join(part, "sample", "left").select(
        "sample", center.alias("center"), (log0 - center).alias("absent")
    )


def _clr_parts(counts: DataFrame, samples: DataFrame, offset: float) -> tuple[DataFrame, DataFrame, int]:
    """Counts written once, the per-sample centres (one row per sample) and the number of samples."""
    src = checkpointed(counts)
    n_features = src.select("feature").distinct().count()
    centers = checkpointed(clr_centers(src, samples, n_features, offset))
    return src, centers, centers.count()


def _clr_cells(src: DataFrame, centers: DataFrame, n: int, offset: float) -> DataFrame:
    return src.join(broadcast_if_small(centers, n, 48), "sample").select(
        "sample", "feature", "reads", (F.log(F.col("reads") + offset) - F.col("center")).alias("clr"), "absent"
    )


def clr_transform(counts: DataFrame, samples: DataFrame, offset: float = 0.5) -> DataFrame:
    """Centred log-ratio of the stored cells; absent cells all equal their sample's ``absent``."""
    return _clr_cells(*_clr_parts(counts, samples, offset), offset)


def complete_cells(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Stored cells plus explicit zeros. Only after the prevalence filter, which bounds the growth.

    Each feature's missing samples are the difference of two sample lists (dimension-sized).
    """
    every = samples.agg(F.collect_set("sample").alias("s")).scalar()
    missing = counts.groupBy("feature").agg(F.collect_set("sample").alias("_have")).select(
        F.explode(F.array_except(every, "_have")).alias("sample"), "feature", F.lit(0).cast("long").alias("reads")
    )
    return counts.select("sample", "feature", "reads").unionByName(missing)


# ---------------------------------------------------------------- linear models


def _gram(design: DataFrame, terms: Sequence[str]) -> tuple[np.ndarray, int]:
    row = design.agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)],
    ).first()
    p = len(terms)
    return np.array([[row[f"{i}_{j}"] for j in range(p)] for i in range(p)]), row["n"]


def _fit_sums(sums: DataFrame, keys: Sequence[str], terms: Sequence[str], inv: np.ndarray, n: int) -> DataFrame:
    """Coefficients from ``xy0..`` and ``yy``: one row per (key, term)."""
    p = len(terms)
    xy = [F.col(f"xy{i}") for i in range(p)]
    beta = [reduce(lambda a, b: a + b, [xy[k] * F.lit(float(inv[j, k])) for k in range(p)]) for j in range(p)]
    sums = sums.withColumns({f"b{j}": beta[j] for j in range(p)})
    rss = F.col("yy") - reduce(lambda a, b: a + b, [F.col(f"b{j}") * xy[j] for j in range(p)])
    sums = sums.withColumn("_s2", F.greatest(rss, F.lit(0.0)) / (n - p))
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("term"), F.col(f"b{j}").alias("estimate"),
                     F.sqrt(F.col("_s2") * F.lit(float(inv[j, j]))).alias("se"))
            for j, t in enumerate(terms)
        ]
    )
    long = sums.select(*keys, F.inline(rows))
    t = F.col("estimate") / F.nullif(F.col("se"), F.lit(0.0))
    return long.withColumn("statistic", t).withColumn("p_value", tails.p_t(F.col("statistic"), F.lit(n - p)))


def feature_glm(cells: DataFrame, absent: DataFrame, design: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of every feature on the design, over all samples.

    ``cells(by.., sample, feature, y)`` are the stored cells, ``absent(by.., sample, y0)`` the value a
    missing cell has in each sample. X'y is the absent-everywhere sum plus a correction per
    stored cell; the aggregation combines map-side and no feature is gathered.
    """
    full, terms, inv, n = _glm_sums(cells, absent, design, by)
    return _fit_sums(full, [*by, "feature"], terms, inv, n)


def _glm_sums(cells: DataFrame, absent: DataFrame, design: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, list[str], np.ndarray, int]:
    """X'y as ``xy0..`` and y'y as ``yy`` of every feature, with the terms, the inverse of X'X and the number of samples."""
    by = list(by)
    terms = [c for c in design.columns if c != "sample"]
    xtx, n = _gram(design, terms)
    inv = np.linalg.inv(xtx)
    side = absent.join(design, "sample")
    zero = side.groupBy(*by).agg(
        *[F.sum(F.col(t) * F.col("y0")).alias(f"z{i}") for i, t in enumerate(terms)],
        F.sum(F.col("y0") * F.col("y0")).alias("zz"),
    )
    rows = max(1, n) * max(1, 16 if by else 1)
    joined = cells.join(broadcast_if_small(side, rows, 16 * (len(terms) + 3)), ["sample", *by])
    diff = F.col("y") - F.col("y0")
    sums = joined.groupBy(*by, "feature").agg(
        *[F.sum(F.col(t) * diff).alias(f"d{i}") for i, t in enumerate(terms)],
        F.sum(F.col("y") * F.col("y") - F.col("y0") * F.col("y0")).alias("dd"),
    )
    if by:
        full = join_null_safe(sums, zero, by)
    else:
        z = zero.first()  # one row of model size
        full = sums.withColumns({c: F.lit(z[c]) for c in zero.columns})
    full = full.select(
        *by, "feature", *[(F.col(f"d{i}") + F.col(f"z{i}")).alias(f"xy{i}") for i in range(len(terms))],
        (F.col("dd") + F.col("zz")).alias("yy"),
    )
    return full, terms, inv, n


def clr_glm(counts: DataFrame, samples: DataFrame, design: DataFrame, offset: float = 0.5) -> DataFrame:
    """Per-feature model of the CLR values with Holm adjustment per term."""
    src, centers, n = _clr_parts(counts, samples, offset)
    clr = _clr_cells(src, centers, n, offset)
    absent = centers.select("sample", F.col("absent").alias("y0"))
    res = feature_glm(clr.select("sample", "feature", F.col("clr").alias("y")), absent, design)
    return adjust_holm(res, ["term"], "p_value")


def pseudo_sensitivity(
    counts: DataFrame, design: DataFrame, grid: Sequence[float], alpha: float = 0.05
) -> DataFrame:
    """Share of pseudo-counts whose call differs from the first grid value's, per (feature, term)."""
    pseudo = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("pseudo")
    cells = counts.select("sample", "feature", "reads", pseudo).select(
        "pseudo", "sample", "feature", F.log(F.col("reads") + F.col("pseudo")).alias("y")
    )
    absent = design.select("sample", pseudo).withColumn("y0", F.log("pseudo"))
    res = feature_glm(cells, absent, design, by=["pseudo"])
    first = F.max(F.when(F.col("pseudo") == float(grid[0]), (F.col("p_value") < alpha).cast("int")))
    calls = res.groupBy("feature", "term").agg(
        first.alias("_base"), F.count_if(F.col("p_value") < alpha).alias("_hits"), F.count("*").alias("_n")
    )
    off = F.when(F.col("_base") == 1, F.col("_n") - F.col("_hits")).otherwise(F.col("_hits"))
    return calls.select("feature", "term", "_base", (off / F.col("_n")).alias("score")).withColumnRenamed(
        "_base", "significant"
    )


def group_contrasts(
    counts: DataFrame, samples: DataFrame, group: str, factors: Sequence[str] = (), numeric: Sequence[str] = (),
    alpha: float = 0.05, offset: float = 0.5,
) -> DataFrame:
    """Directional contrasts of all pairs of ``group`` levels on the CLR scale, with other design terms as covariates.

    ``(feature, contrast, estimate, se, statistic, p_value, p_adj, global_p, global_q, direction)``. One model per feature has
    the group and the covariates; contrasts follow from its coefficients and their covariance. The error rate is the
    mixed directional one: the F test that all levels are equal is adjusted over the features (``global_q``), and a contrast of
    one of the ``R`` of ``m`` features below ``alpha`` has a ``direction`` (1 or -1, else 0) if its Holm-adjusted p-value
    within the feature (``p_adj``) is at most ``alpha * R / m``.
    """
    src, centers, n_samples = _clr_parts(counts, samples, offset)
    design = checkpointed(design_matrix(samples, [group, *factors], numeric))
    levels = level_list(samples, group)
    clr = _clr_cells(src, centers, n_samples, offset)
    absent = centers.select("sample", F.col("absent").alias("y0"))
    sums, terms, inv, n = _glm_sums(clr.select("sample", "feature", F.col("clr").alias("y")), absent, design)
    p = len(terms)
    xy = [F.col(f"xy{i}") for i in range(p)]
    dot = lambda ws, cs: reduce(lambda a, b: a + b, [F.lit(float(w)) * c for w, c in zip(ws, cs)])
    sums = sums.withColumns({f"b{j}": dot(inv[j], xy) for j in range(p)})
    b = [F.col(f"b{j}") for j in range(p)]
    rss = F.col("yy") - reduce(lambda x, y: x + y, [b[j] * xy[j] for j in range(p)])
    place = {lv: (terms.index(f"{group}{lv}") if lv != levels[0] else None) for lv in levels}
    at = [place[lv] for lv in levels[1:]]
    middle = np.linalg.inv(inv[np.ix_(at, at)])
    quad = reduce(lambda x, y: x + y, [F.lit(float(middle[i, j])) * b[k] * b[m] for i, k in enumerate(at) for j, m in enumerate(at)])
    s2 = F.greatest(rss, F.lit(0.0)) / (n - p)
    sums = checkpointed(sums.select("feature", *b, s2.alias("_s2"), (quad / len(at)).alias("_ms")))
    whole = sums.withColumn("_f", F.col("_ms") / F.nullif(F.col("_s2"), F.lit(0.0))).withColumn(
        "global_p", tails.p_f(F.col("_f"), F.lit(len(at)), F.lit(n - p))
    )
    whole = checkpointed(adjust_bh(whole.withColumn("_all", F.lit(1)), ["_all"], "global_p", "global_q"))
    found = whole.agg(F.count("global_p").alias("m"), F.count_if(F.col("global_q") <= alpha).alias("r")).first()
    rows = []
    for x in range(len(levels)):
        for y in range(x + 1, len(levels)):
            w = np.zeros(p)
            for lv, sign in ((levels[y], 1.0), (levels[x], -1.0)):
                if place[lv] is not None:
                    w[place[lv]] += sign
            rows.append(F.struct(
                F.lit(f"{levels[y]} - {levels[x]}").alias("contrast"), dot(w, b).alias("estimate"),
                F.sqrt(F.col("_s2") * F.lit(float(w @ inv @ w))).alias("se"),
            ))
    long = whole.select("feature", "global_p", "global_q", F.inline(F.array(*rows)))
    res = long.withColumn("statistic", F.col("estimate") / F.nullif(F.col("se"), F.lit(0.0))).withColumn(
        "p_value", tails.p_t(F.col("statistic"), F.lit(n - p))
    )
    bound = alpha * found["r"] / max(1, found["m"])
    sure = (F.col("global_q") <= alpha) & (F.col("p_adj") <= bound)
    return adjust_holm(res, ["feature"], "p_value").withColumn(
        "direction", F.when(sure, F.signum("estimate").cast("int")).otherwise(0)
    )


# ---------------------------------------------------------------- Monte-Carlo instances


def _log_gamma_draws(it: Iterator[pd.DataFrame], instances: int, offset: float) -> Iterator[pd.DataFrame]:
    for pdf in it:
        draws = []
        for key, reads in zip(pdf["key"], pdf["reads"]):
            rng = np.random.Generator(np.random.Philox(key=int(key) & 0xFFFFFFFFFFFFFFFF))
            shape = reads + offset
            # log Gamma(a) = log Gamma(a + 1) + log(U) / a keeps small shapes away from zero
            draws.append(np.log(rng.standard_gamma(shape + 1, instances)) + np.log(rng.random(instances)) / shape)
        yield pdf[["sample", "feature"]].assign(draws=draws)


def dirichlet_clr_instances(
    counts: DataFrame, samples: DataFrame, instances: int = 128, seed: int = 1, offset: float = 0.5
) -> DataFrame:
    """``(sample, feature, clr array)``: CLR of Dirichlet posterior draws, one entry per instance.

    A cell's generator is keyed by (seed, sample, feature), so a retried task draws the same values.
    """
    cells = complete_cells(checkpointed(counts), samples).withColumn("key", F.xxhash64(F.lit(seed), "sample", "feature"))
    ft = counts.schema["feature"].dataType.simpleString()
    st = counts.schema["sample"].dataType.simpleString()
    drawn = checkpointed(
        cells.mapInPandas(
            lambda it: _log_gamma_draws(it, instances, offset), f"sample {st}, feature {ft}, draws array<double>"
        )
    )
    mean = (
        drawn.select("sample", F.posexplode("draws").alias("k", "v"))
        .groupBy("sample", "k").agg(F.avg("v").alias("m"))
        .groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("_c"))  # one per instance
    )
    return drawn.join(mean, "sample").select(
        "sample", "feature", F.zip_with("draws", "_c", lambda x, c: x - c["m"]).alias("clr")
    )


def glm_over_instances(instances: DataFrame, design: DataFrame) -> DataFrame:
    """Model of every instance; estimates, p and Holm-adjusted p averaged per (feature, term)."""
    terms = [c for c in design.columns if c != "sample"]
    xtx, n = _gram(design, terms)
    rows = instances.select("sample", "feature", F.posexplode("clr").alias("instance", "y"))
    joined = rows.join(broadcast_if_small(design, n, 16 * (len(terms) + 1)), "sample")
    sums = joined.groupBy("instance", "feature").agg(
        *[F.sum(F.col(t) * F.col("y")).alias(f"xy{i}") for i, t in enumerate(terms)],
        F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
    res = _fit_sums(sums, ["instance", "feature"], terms, np.linalg.inv(xtx), n)
    adj = adjust_holm(res, ["instance", "term"], "p_value")
    return adj.groupBy("feature", "term").agg(
        *[F.avg(c).alias(c) for c in ("estimate", "se", "statistic", "p_value", "p_adj")]
    )


#: Picks of a term that a task holds at a time.
_PICKS = 1 << 18


class _Group:
    """The instances of some samples of a feature, one after the other, where they lie."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.values, self.starts = values, starts
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.size, self.width = int(self.before[-1]), int(sizes[0]) if len(sizes) and (sizes == sizes[0]).all() else 0

    def take(self, i: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(i), np.nan)
        row = i // self.width if self.width else np.searchsorted(self.before, i, side="right") - 1
        return self.values[self.starts[row] + (i - self.before[row])]


def _ranked(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers ``v``."""
    bits = (v + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


class _Median:
    """The exact median of numbers that come twice in blocks: counted by their first bits, then kept where it lies."""

    def __init__(self):
        self.counts, self.none = np.zeros(1 << 16, np.int64), 0

    def count(self, v: np.ndarray) -> None:
        known = v[~np.isnan(v)]
        self.none += len(v) - len(known)
        self.counts += np.bincount((_ranked(known) >> 48) + (1 << 15), minlength=1 << 16)

    def seek(self) -> None:
        n = int(self.counts.sum())
        self.ends = np.cumsum(self.counts)
        self.places = [(n - 1) // 2, n // 2] if n else []
        self.bins = np.unique(np.searchsorted(self.ends, self.places, side="right"))
        self.kept: list[np.ndarray] = []

    def keep(self, v: np.ndarray) -> None:
        if len(self.bins):
            known = v[~np.isnan(v)]
            self.kept.append(known[np.isin((_ranked(known) >> 48) + (1 << 15), self.bins)])

    def value(self, skip_none: bool) -> float:
        if not self.places or (self.none and not skip_none):
            return float("nan")
        some = np.concatenate(self.kept)
        # the kept lie in one part of the order, or in two with nothing between
        first = int(self.ends[self.bins[0]] - self.counts[self.bins[0]])
        at = [p - first for p in self.places]
        some.partition(at)
        with np.errstate(all="ignore"):
            return float(np.mean(some[at]))


def effect_sizes(va: _Group, vb: _Group, seed: int) -> tuple[float, float, float, float]:
    """``(diff_btw, diff_win, effect, overlap)`` of as many picks as the larger group has instances.

    The six streams of picks follow each other in one generator: its state at the start of each is found first, then all
    are made side by side, block by block, twice.
    """
    rng = np.random.default_rng(seed)
    a, b = max(1, va.size), max(1, vb.size)
    size = max(a, b)
    states = []
    for n in (b, a, a, a, b, b):
        states.append(rng.bit_generator.state)
        for at in range(0, size, _PICKS):
            rng.integers(0, n, min(_PICKS, size - at))

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        streams = []
        for state, group, n in zip(states, (vb, va, va, va, vb, vb), (b, a, a, a, b, b)):
            own = np.random.default_rng(seed)
            own.bit_generator.state = state
            streams.append((own, group, n))
        for at in range(0, size, _PICKS):
            x = [group.take(own.integers(0, n, min(_PICKS, size - at))) for own, group, n in streams]
            between = x[0] - x[1]
            within = np.maximum(np.abs(x[2] - x[3]), np.abs(x[4] - x[5]))
            with np.errstate(all="ignore"):
                yield between, within, between / within

    medians, low, high = [_Median() for _ in range(3)], 0, 0
    for block in blocks():
        low, high = low + int((block[0] < 0).sum()), high + int((block[0] > 0).sum())
        for m, v in zip(medians, block):
            m.count(v)
    for m in medians:
        m.seek()
    for block in blocks():
        for m, v in zip(medians, block):
            m.keep(v)
    found = [m.value(i == 2) for i, m in enumerate(medians)]
    return found[0], found[1], found[2], min(low, high) / size


def _effects(terms: Sequence[str], seed: int):
    """A row per feature and term; the rows come sorted by feature and sample."""

    def rows(feature: pa.Scalar, values: np.ndarray, sizes: list[np.ndarray], groups: list[np.ndarray]) -> pa.RecordBatch:
        size, level = np.concatenate(sizes), np.concatenate(groups)
        start = np.cumsum(size) - size
        out = []
        for i in range(len(terms)):
            va, vb = (_Group(values, start[own], size[own]) for own in (level[:, i] == 0, level[:, i] == 1))
            out.append(effect_sizes(va, vb, seed))
        columns = [pa.array([feature.as_py()] * len(terms), feature.type), pa.array(terms, pa.string())]
        return pa.RecordBatch.from_arrays(
            [*columns, *(pa.array(c, pa.float64()) for c in zip(*out))],
            names=["feature", "term", "diff_btw", "diff_win", "effect", "overlap"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, used = None, np.empty(0), 0
        sizes: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        for b in batches:
            coded = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            coded = np.nan_to_num(coded.astype(float), nan=-1)
            cuts = [0, *(np.flatnonzero(np.diff(coded)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                part = b.slice(s, e - s)
                feature = part.column(0)[0]
                if now is None or feature.as_py() != now.as_py():
                    if now is not None:
                        yield rows(now, values, sizes, groups)
                    now, used, sizes, groups = feature, 0, [], []
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if used + len(flat) > len(values):
                    values.resize(max(used + len(flat), len(values) * 5 // 4), refcheck=False)  # grown in place
                values[used : used + len(flat)] = flat
                used += len(flat)
                sizes.append(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                groups.append(np.stack([part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(terms))], axis=1))
        if now is not None:
            yield rows(now, values, sizes, groups)

    return run


def feature_effect_size(instances: DataFrame, design: DataFrame, seed: int = 1) -> DataFrame:
    """Between and within group differences, effect and overlap per feature and 0/1 term of the design.

    The groups of a term are the samples coded 1 and 0, so a difference has the sign of the model's estimate.
    A task holds the instances of one feature at a time, 8 bytes each, and no array of its picks: these are made again
    for a second pass, which finds the medians.
    """
    terms = [c for c in design.columns if c != "sample"]
    coded = design.agg(*[(F.min(F.col(f"`{t}`").isin(0, 1)) & (F.min(f"`{t}`") < F.max(f"`{t}`"))).alias(t) for t in terms]).first()
    terms = [t for t in terms if coded[t]]
    ft = instances.schema["feature"].dataType
    schema = T.StructType([T.StructField("feature", ft), T.StructField("term", T.StringType())] + [
        T.StructField(c, T.DoubleType()) for c in ("diff_btw", "diff_win", "effect", "overlap")
    ])
    if not terms:
        return instances.sparkSession.createDataFrame([], schema)
    groups = [F.col(f"`{t}`").cast("int").alias(f"g{i}") for i, t in enumerate(terms)]
    rows = instances.join(design.select("sample", *groups), "sample")
    laid = rows.repartition("feature").sortWithinPartitions("feature", "sample")
    wide = laid.select("feature", "clr", *[f"g{i}" for i in range(len(terms))])
    return wide.mapInArrow(_effects(terms, seed), schema)


# ---------------------------------------------------------------- bias-corrected model


def _normal_sums(cells: DataFrame, terms: Sequence[str]) -> DataFrame:
    p = len(terms)
    sums = [f"sum(`{terms[i]}` * `{terms[j]}`) AS xx{i}_{j}" for i in range(p) for j in range(i, p)]
    sums += [f"sum(`{t}` * y) AS xy{i}" for i, t in enumerate(terms)]
    return cells.groupBy("feature").agg(F.expr("count(*) AS n"), *[F.expr(e) for e in sums], F.expr("sum(y * y) AS yy"))


def normal_sums(counts: DataFrame, design: DataFrame) -> DataFrame:
    """Per feature, over its non-zero cells: X'X, X'y and y'y of the log counts."""
    terms = [c for c in design.columns if c != "sample"]
    cells = counts.where("reads > 0").join(design, "sample").withColumn("y", F.log("reads"))
    return _normal_sums(cells, terms)


def _solve(p: int):
    """Vectorised per-feature solve: adds ``beta`` and the diagonal of the inverse."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            xx = np.zeros((len(pdf), p, p))
            for i in range(p):
                for j in range(i, p):
                    xx[:, i, j] = xx[:, j, i] = pdf[f"xx{i}_{j}"].to_numpy(float)
            inv = np.linalg.pinv(xx, hermitian=True)
            yield pdf[["feature", "n"]].assign(inv=list(inv.reshape(len(pdf), p * p)),
                                               rank=np.linalg.matrix_rank(xx, hermitian=True))
    return run


def _by_feature(cells: DataFrame, features: int) -> DataFrame:
    """Deal the cells by feature, if there are enough features that tasks get alike shares."""
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cells.repartition(width, "feature") if features >= 8 * width else cells


def _alternate(counts: DataFrame, design: DataFrame, tol: float, max_iter: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log cells with their design, coefficients per feature (with ``n``, ``inv`` and ``b0..``) and ``(sample, theta)``.

    Zeros are missing. Each feature's X'X is inverted once; an iteration is two grouped sums (X'y per feature, mean
    residual per sample). Results of a step are checkpointed, so lineage stays short and a lost executor only repeats the
    current step.
    """
    terms = [c for c in design.columns if c != "sample"]
    p = len(terms)
    ft = counts.schema["feature"].dataType.simpleString()
    n = design.count()
    side = broadcast_if_small(design, n, 16 * (p + 1))
    cells = checkpointed(
        counts.where("reads > 0").join(side, "sample").select("sample", "feature", F.log("reads").alias("y"), *terms)
    )
    solved = _normal_sums(cells, terms).mapInPandas(
        _solve(p), f"feature {ft}, n long, inv array<double>, rank long"
    )
    solved = checkpointed(solved.where((F.col("rank") == p) & (F.col("n") > p)).select("feature", "n", "inv"))
    # the cells of a feature lie together, so that its sums leave a task as one row in every step
    cells = checkpointed(_by_feature(cells.join(solved.select("feature"), "feature", "left_semi"), solved.count()))
    theta = checkpointed(design.select("sample", F.lit(0.0).alias("theta")))
    # SQL text: the loop below would otherwise build hundreds of Column objects per step
    coef = [" + ".join(f"inv[{j * p + k}] * xy{k}" for k in range(p)) + f" AS b{j}" for j in range(p)]
    fitted = _fitted(terms)
    names = [f"b{j}" for j in range(p)]
    xy_sums = [F.expr(f"sum(`{t}` * (y - theta))").alias(f"xy{k}") for k, t in enumerate(terms)]

    for _ in range(max_iter):
        xy = cells.join(broadcast_if_small(theta, n, 24), "sample").groupBy("feature").agg(*xy_sums)
        beta = checkpointed(solved.join(xy, "feature").selectExpr("feature", "n", "inv", *coef))
        resid = cells.join(beta.select("feature", *names), "feature")
        step = checkpointed(resid.groupBy("sample").agg(F.expr(f"avg(y - ({fitted}))").alias("theta")))
        change = step.join(theta.withColumnRenamed("theta", "old"), "sample").selectExpr(
            "max(abs(theta - old))").first()[0]
        theta = step
        if change is None or change < tol:
            break
    return cells, beta, theta


def _fitted(terms: Sequence[str]) -> str:
    return " + ".join(f"`{t}` * b{j}" for j, t in enumerate(terms))


def sampling_fractions(counts: DataFrame, design: DataFrame, tol: float = 1e-2, max_iter: int = 20) -> DataFrame:
    """``(sample, samp_frac)``: the sample bias of the log-linear model; samples without a cell have no row."""
    return _alternate(counts, design, tol, max_iter)[2].withColumnRenamed("theta", "samp_frac")


def bias_corrected_glm(
    counts: DataFrame, design: DataFrame, alpha: float = 0.05, tol: float = 1e-2, max_iter: int = 20,
    em_tol: float = 1e-5, em_iter: int = 100, s0_perc: float = 0.05,
) -> tuple[DataFrame, DataFrame]:
    """Log-linear model with sample and coefficient bias removed.

    Returns ``results(feature, term, lfc, se, w, p, q, diff)`` and ``fractions(sample, samp_frac)``. The sample bias comes from
    alternating sums (``_alternate``). The coefficient bias is the centre of a three-part normal mixture over
    features, fitted with grouped sums per EM step; ``se`` holds its standard deviation, too.
    """
    terms = [c for c in design.columns if c != "sample"]
    p, n = len(terms), design.count()
    cells, beta, theta = _alternate(counts, design, tol, max_iter)
    names = [f"b{j}" for j in range(p)]
    full = cells.join(broadcast_if_small(theta, n, 24), "sample").join(beta.select("feature", *names), "feature")
    rss = full.groupBy("feature").agg(F.expr(f"sum(pow(y - theta - ({_fitted(terms)}), 2))").alias("rss"))
    rows = F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"b{j}").alias("beta"),
                 (F.element_at("inv", j * p + j + 1) * F.col("rss") / (F.col("n") - p)).alias("nu"))
        for j, t in enumerate(terms) if t != "intercept"
    ])
    est = checkpointed(beta.join(rss, "feature").select("feature", "n", F.inline(rows)).where("nu > 0"))
    bias = _mixture_bias(est, em_tol, em_iter)
    of_term = lambda i: reduce(
        lambda w, kv: w.when(F.col("term") == kv[0], F.lit(kv[1][i])), bias.items(), F.when(F.lit(False), F.lit(0.0))
    )
    delta = of_term(0)
    # the standard deviations of coefficient and bias add up, as the two may be dependent
    se = est.withColumn("se0", F.sqrt("nu") + F.sqrt(of_term(1)))
    s0 = quantiles(se.select("term", "se0"), ["term"], "se0", {"s0": s0_perc}).select("term", "s0")
    res = se.join(F.broadcast(s0), "term").select(  # one row per model term
        "feature", "term", (F.col("beta") - delta).alias("lfc"), F.col("se0").alias("se"),
        ((F.col("beta") - delta) / (F.col("se0") + F.col("s0"))).alias("w"), (F.col("n") - p).alias("df"),
    ).withColumn("p", tails.p_t(F.col("w"), F.col("df")))
    out = adjust_holm(res, ["term"], "p", "q").withColumn("diff", F.col("q") < alpha)
    return out, theta.withColumnRenamed("theta", "samp_frac")


def _mixture_bias(est: DataFrame, tol: float, max_iter: int) -> dict[str, tuple[float, float]]:
    """Per term, the null centre of null + negative + positive normal parts and its variance; grouped sums per step.

    The parameters of a step are one array literal, indexed by the row's term, which generated code
    refers to instead of spelling it out: every step reuses the compiled plan.
    """
    start = quantiles(est.select("term", "beta"), ["term"], "beta",
                      {"lo": 0.125, "q1": 0.25, "q3": 0.75, "hi": 0.875}).collect()
    names = ("d", "l1", "l2", "k1", "k2", "p0", "p1", "p2")
    par = {}
    for r in start:
        c = (r["q1"] + r["q3"]) / 2
        spread = max(((r["q3"] - r["q1"]) / 1.349) ** 2, 1e-8)
        par[r["term"]] = (c, min(r["lo"] - c, -1e-3), max(r["hi"] - c, 1e-3), spread, spread, 0.75, 0.125, 0.125)
    order = sorted(par)
    number = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(order))
    est = est.selectExpr("term", "beta", "nu", f"CASE term {number} END * {len(names)} AS at")
    unpack = ["term", "beta", "nu", *[f"par[at + {i}] AS {c}" for i, c in enumerate(names)]]
    # densities of the three parts, then the weighted sums of the maximisation step, as SQL text
    parts = [
        "*", "nu + k1 AS v1", "nu + k2 AS v2", "p0 * exp(-pow(beta - d, 2) / (2 * nu)) / sqrt(nu) AS f0",
        "p1 * exp(-pow(beta - d - l1, 2) / (2 * (nu + k1))) / sqrt(nu + k1) AS f1",
        "p2 * exp(-pow(beta - d - l2, 2) / (2 * (nu + k2))) / sqrt(nu + k2) AS f2",
    ]
    shares = ["*", *[f"f{i} / (f0 + f1 + f2 + 1e-300) AS r{i}" for i in range(3)]]
    sums = [F.expr(e) for e in (
        "sum(r0 / nu * beta + r1 / v1 * (beta - l1) + r2 / v2 * (beta - l2)) AS num",
        "sum(r0 / nu + r1 / v1 + r2 / v2) AS den",
        "sum(r1 / v1 * (beta - d)) AS n1", "sum(r1 / v1) AS d1", "sum(r2 / v2 * (beta - d)) AS n2",
        "sum(r2 / v2) AS d2", "sum(r1 * (pow(beta - d - l1, 2) - nu)) AS q1",
        "sum(r2 * (pow(beta - d - l2, 2) - nu)) AS q2", "avg(r0) AS a0", "avg(r1) AS a1", "avg(r2) AS a2",
        "sum(r1) AS s1", "sum(r2) AS s2",
    )]
    spread_of = dict.fromkeys(par, 0.0)
    for _ in range(max_iter):
        flat = ", ".join(f"{float(v)!r}D" for t in order for v in par[t])
        joined = est.selectExpr("*", f"array({flat}) AS par").selectExpr(*unpack)
        agg = joined.selectExpr(*parts).selectExpr(*shares).groupBy("term").agg(*sums).collect()  # one row per term
        move = 0.0
        for a in agg:
            new = (
                a["num"] / a["den"], min(0.0, a["n1"] / max(a["d1"], 1e-12)),
                max(0.0, a["n2"] / max(a["d2"], 1e-12)), max(0.0, a["q1"] / max(a["s1"], 1e-12)),
                max(0.0, a["q2"] / max(a["s2"], 1e-12)), a["a0"], a["a1"], a["a2"],
            )
            move = max(move, abs(new[0] - par[a["term"]][0]))
            par[a["term"]], spread_of[a["term"]] = new, 1 / a["den"]
        if move < tol:
            break
    return {k: (v[0], spread_of[k]) for k, v in par.items()}


def structural_zeros(counts: DataFrame, samples: DataFrame, group: str, neg_lb: bool = True) -> DataFrame:
    """Presence share per (feature, group level) and whether the feature is absent there by design."""
    sizes = samples.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).collect()  # per level
    sizes = sorted(sizes, key=lambda r: (str(r["g"]).lower(), str(r["g"])))
    present = counts.where("reads > 0").join(samples.select("sample", F.col(group).alias("g")), "sample")
    per = present.groupBy("feature").agg(*[F.count_if(F.col("g") == r["g"]).alias(f"c{i}") for i, r in enumerate(sizes)])
    rows = F.array(*[
        F.struct(F.lit(r["g"]).alias("level"), F.col(f"c{i}").alias("present"), F.lit(r["n"]).alias("size"))
        for i, r in enumerate(sizes)
    ])
    share = F.col("present") / F.col("size")
    lower = share - 1.96 * F.sqrt(share * (1 - share) / F.col("size"))
    zero = (share == 0) | (lower <= 0) if neg_lb else share == 0
    return per.select("feature", F.inline(rows)).select("feature", "level", share.alias("share"), zero.alias("zero"))


def bias_corrected_abundance(counts: DataFrame, samples: DataFrame, fractions: DataFrame) -> DataFrame:
    """``log(reads + 1) - samp_frac`` for every cell, with the design fields cut from the sample name."""
    cells = complete_cells(counts, samples)
    name = F.col("name")
    side = samples.select("sample", "name").join(fractions, "sample", "left")
    return cells.join(side, "sample").select(
        F.col("feature").alias("taxon"), name.alias("community"),
        (F.log(F.col("reads") + 1) - F.coalesce("samp_frac", F.lit(0.0))).alias("bc"),
        F.concat_ws(" ", S.str_sub(name, 3, 10), S.str_sub(name, -1, -1)).alias("pen"),
        S.str_sub(name, 11, 12).alias("age"), S.str_sub(name, 3, 9).alias("cohort"),
    )


def term_slice(results: DataFrame, contains: str) -> DataFrame:
    """Results of the model terms whose name contains the text."""
    return results.where(F.col("term").contains(contains))


def concordance(first: DataFrame, second: DataFrame, effect: str = "estimate") -> DataFrame:
    """Two methods side by side: worst log10 adjusted p and the conservative sign class."""
    a = first.select("feature", "term", F.col("p_adj").alias("p1"), F.col(effect).alias("effect"))
    b = second.select("feature", "term", F.col("p_adj").alias("p2"))
    both = a.join(b, ["feature", "term"], "left")
    return both.withColumns({
        "worst": S.greatest_strict(F.log10(F.greatest("p1", F.lit(1e-300))), F.log10(F.greatest("p2", F.lit(1e-300)))),
        "class": S.effect_class(F.col("p1"), F.col("p2"), F.col("effect")),
    })


# ---------------------------------------------------------------- association with analytes


def feature_analyte_correlation(cells: DataFrame, samples: DataFrame, analytes: DataFrame, stratum: str) -> DataFrame:
    """Spearman of every feature with every analyte inside a stratum of the design, zeros included.

    ``cells(sample, feature, x)`` of any sign, ``analytes(sample, analyte, value)``. Absent cells are zero, like
    stored zeros: they tie between the negative and the positive cells, so their ranks and cross products
    are added arithmetically and nothing is widened. Values whose absent cells are no constant
    (bias-corrected ones) come with every cell stored. A NaN is a missing value of an
    analyte and an absent cell. The rank windows hold at most one row per sample. ``q`` is the Benjamini-Hochberg
    adjusted p-value within (stratum, analyte).
    """
    dim = samples.select("sample", F.col(stratum).alias("stratum"))
    vals = usable(analytes, "value").join(dim, "sample")
    rk, _ = window_ranks(["stratum", "analyte"], "value")
    vals = checkpointed(vals.select("sample", "stratum", "analyte", "value", rk.alias("ry")))
    dims = vals.groupBy("stratum", "analyte").agg(
        F.count("*").alias("n"), F.sum(F.col("ry") * F.col("ry")).alias("yy"), F.sum("ry").alias("y_all")
    )
    dims = checkpointed(dims)
    names = sorted(r[0] for r in dims.select("analyte").distinct().collect() if r[0] is not None)  # one row per analyte
    code = (F.array_position(F.array(*map(F.lit, names)), F.col("analyte")) - 1).cast("int") if names else F.lit(None).cast("int")
    # a sample's values are one row: cells are moved once, not once per analyte
    of = vals.withColumn("code", code).where("code IS NOT NULL").groupBy("sample", "stratum").agg(F.collect_list(F.struct("code", "ry")).alias("of"))
    of = checkpointed(of.select("sample", "stratum", F.col("of.code").alias("codes"), F.col("of.ry").alias("rys")))
    size = of.agg(F.count("*"), F.sum(F.size("codes"))).first()
    seen = usable(cells, "x").where("x <> 0").select("sample", "feature", "x")
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if 64 * size[0] + 12 * (size[1] or 0) <= BROADCAST_BYTES:
        # a sample without a stratum or value counts for none
        seen = seen.join(F.broadcast(of.select("sample", "stratum")), "sample").repartition(width, "feature", "stratum")
        seen = seen.join(F.broadcast(of.withColumnRenamed("stratum", "_s")), "sample").where(F.col("_s") == F.col("stratum"))
    else:
        seen = seen.join(of, "sample").repartition(width, "feature", "stratum")
    seen = seen.select("feature", "stratum", "x", F.inline(F.arrays_zip("codes", "rys")).alias("code", "ry"))
    up, _ = window_ranks(["feature", "stratum", "code"], "x")
    ranked = seen.withColumn("up", up)
    sums = ranked.groupBy("feature", "stratum", "code").agg(
        F.count("*").alias("k"), F.sum(F.col("up") * F.col("up")).alias("uu"),
        F.sum(F.col("up") * F.col("ry")).alias("uy"), F.sum("ry").alias("y"),
        F.count_if(F.col("x") > 0).alias("kp"), F.sum(F.when(F.col("x") > 0, F.col("up")).otherwise(0.0)).alias("up_pos"),
        F.sum(F.when(F.col("x") > 0, F.col("ry")).otherwise(0.0)).alias("y_pos"),
    )
    j = sums.join(F.broadcast(dims.withColumn("code", code)), ["stratum", "code"])  # one row per design stratum and analyte
    n, k, kp = (F.col(c).cast("double") for c in ("n", "k", "kp"))
    z = n - k  # zero cells: after the negative ones, before the positive ones, which they shift by z
    zr = k - kp + (z + 1) / 2
    xx = F.col("uu") + 2 * z * F.col("up_pos") + kp * z * z + z * zr * zr
    xy = F.col("uy") + z * F.col("y_pos") + zr * (F.col("y_all") - F.col("y"))
    mean = (n + 1) / 2
    cov = xy - n * mean * mean
    rho = cov / F.nullif(F.sqrt((xx - n * mean * mean) * (F.col("yy") - n * mean * mean)), F.lit(0.0))
    res = j.select("stratum", "analyte", "feature", F.col("n").cast("long").alias("n"), rho.alias("estimate"))
    res = res.withColumn("p_value", tails.p_spearman(F.col("estimate"), F.col("n"), F.lit(True)))
    return adjust_bh(res, ["stratum", "analyte"], "p_value", "q")


def agreement_table(first: DataFrame, second: DataFrame, q: str = "q", alpha: float = 0.05) -> DataFrame:
    """Both routes' adjusted p-values and signs for every key they share, and whether they agree at ``alpha``.

    Zero, and what is zero but for rounding errors, counts as positive.
    """
    keys = ["stratum", "analyte", "feature"]
    side = lambda df, s: df.select(
        *keys, F.col(q).alias(f"q_{s}"), F.when(F.round("estimate", 9) < 0, 0).otherwise(1).alias(f"sign_{s}")
    )
    both = side(first, "bc").join(side(second, "ra"), keys)
    agree = (F.col("q_bc") <= alpha) & (F.col("q_ra") <= alpha) & (F.col("sign_bc") == F.col("sign_ra"))
    return both.withColumn("agrees", F.coalesce(agree, F.lit(False)))


def correlation_agreement(first: DataFrame, second: DataFrame, q: str = "q", alpha: float = 0.05) -> DataFrame:
    """Keys significant in both tables with the same sign; zero counts as positive."""
    keys = ["stratum", "analyte", "feature"]
    side = lambda df, s: df.where(F.col(q) <= alpha).select(
        *keys, F.when(F.col("estimate") < 0, 0).otherwise(1).alias(f"sign_{s}")
    )
    return side(first, "bc").join(side(second, "ra"), keys).where("sign_bc = sign_ra")


def control_rank_table(ranked: DataFrame, controls: DataFrame, features: Sequence[str]) -> DataFrame:
    """``reads (rank)`` of key features in the control samples; ranks were taken over all samples."""
    text = F.concat(F.col("reads").cast("string"), F.lit(" ("), F.col("rank").cast("string"), F.lit(")"))
    return (
        ranked.where(F.col("feature").isin(list(features))).join(controls, "sample", "left_semi")
        .withColumn("cell", text).groupBy("sample").pivot("feature", list(features)).agg(F.first("cell"))
    )


def agglomerate(counts: DataFrame, taxa: DataFrame, rank: int) -> DataFrame:
    """Counts summed to the name at a rank of the lineage."""
    label = F.try_element_at(S.parse_taxonomy(F.col("taxonomy")), F.lit(rank))["name"]
    names = taxa.select("feature", label.alias("label"))
    return counts.join(names, "feature").groupBy("sample", "label").agg(F.sum("reads").alias("reads"))
