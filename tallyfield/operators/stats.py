"""Stratified tests from grouped sums over ranked value counts.

No test collects a stratum: rows are collapsed to (stratum, level, value) counts, ranked by
``ranks.rank_table``, and reduced to one row per stratum or level pair before any tail
probability is evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..session import checkpointed
from .adjust import adjust_bh
from .ranks import attach, join_null_safe, quantiles, rank_table, with_rank

EXACT_BELOW = 50  # rank-sum is exact under this size per group when nothing ties


def _tie_term() -> Column:
    # sum(t^3 - t) over tied blocks, spread over the rows of each block
    return F.sum(F.col("n") * (F.col("ties").cast("double") * F.col("ties") - 1))


def usable(df: DataFrame, value: str, *levels: str) -> DataFrame:
    """Rows a test can use: a value that is a number, and no missing factor level."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for c in levels:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok)


def level_rank_sums(
    df: DataFrame, strata: Sequence[str], value: str, level: str, weight: str | None = None
) -> DataFrame:
    """Per (stratum, level): size ``n``, rank sum and the level's share of the tie term.

    ``weight`` names the row count when ``df`` already holds collapsed rows.
    """
    return (
        rank_table(usable(df, value, level), strata, value, by=[level], weight=weight)
        .groupBy(*strata, level)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("midrank")).alias("rank_sum"),
            _tie_term().alias("tie"),
        )
    )


def _kruskal_from_sums(sums: DataFrame, strata: Sequence[str]) -> DataFrame:
    total = sums.groupBy(*strata).agg(
        F.sum("n").cast("double").alias("_N"),
        F.count("*").alias("_k"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s"),
        F.sum("tie").alias("_tie"),
    )
    big = F.col("_N")
    raw = 12.0 / (big * (big + 1)) * F.col("_s") - 3 * (big + 1)
    h = raw / F.nullif(1 - F.col("_tie") / (big * big * big - big), F.lit(0.0))
    return total.select(
        *strata, big.cast("long").alias("n"), h.alias("statistic"), (F.col("_k") - 1).alias("df")
    ).withColumn("p_value", tails.p_chi2(F.col("statistic"), F.col("df")))


def kruskal_wallis(df: DataFrame, strata: Sequence[str], value: str, level: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, one row per stratum."""
    return _kruskal_from_sums(level_rank_sums(df, strata, value, level), strata)


def level_pairs(levels: DataFrame, strata: Sequence[str], level: str, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of factor levels inside each stratum, ``level_a`` before ``level_b``.

    ``levels`` holds one row per (stratum, level), so the pairs are bounded by the design. Levels
    are ordered without regard to case, then by text.
    """
    key = lambda c: F.struct(F.lower(c), c)
    side = lambda s: levels.select(
        *strata, F.col(level).alias(f"level_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]
    )
    a, b = side("a"), side("b")
    if not strata:
        a, b = a.withColumn("_all", F.lit(1)), b.withColumn("_all", F.lit(1))
    keys = list(strata) or ["_all"]
    return join_null_safe(a, b, keys).where(key(F.col("level_a")) < key(F.col("level_b"))).drop("_all")


def dunn_test(df: DataFrame, strata: Sequence[str], value: str, level: str) -> DataFrame:
    """Dunn's pairwise z on the ranks of the whole stratum, Benjamini-Hochberg adjusted."""
    strata = list(strata)
    # one row per stratum and level, read for both sides of the pairs and for the totals
    sums = checkpointed(level_rank_sums(df, strata, value, level))
    total = sums.groupBy(*strata).agg(F.sum("n").cast("double").alias("_N"), F.sum("tie").alias("_T"))
    pairs = join_null_safe(level_pairs(sums, strata, level, ["n", "rank_sum"]), total, strata)
    big = F.col("_N")
    var = (big * (big + 1) / 12 - F.col("_T") / (12 * (big - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    z = (F.col("rank_sum_a") / F.col("n_a") - F.col("rank_sum_b") / F.col("n_b")) / F.sqrt(var)
    out = pairs.select(
        *strata, F.concat_ws(" - ", "level_a", "level_b").alias("comparison"), z.alias("statistic")
    ).withColumn("p_value", tails.p_normal_two_sided(F.col("statistic")))
    return adjust_bh(out, strata, "p_value")


def _rank_sum(sums: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Two-level rank sums -> W, normal and exact p. Input: one row per (stratum, level)."""
    key = F.struct(F.lower("level"), F.col("level"))
    wide = sums.groupBy(*strata).agg(
        F.min_by("n", key).cast("double").alias("n1"),
        F.max_by("n", key).cast("double").alias("n2"),
        F.min_by("rank_sum", key).alias("r1"),
        F.min_by("level", key).alias("group1"),
        F.max_by("level", key).alias("group2"),
        F.sum("tie").alias("tie"),
        F.count("*").alias("k"),
    ).where("k = 2")
    n1, n2 = F.col("n1"), F.col("n2")
    big = n1 + n2
    w = F.col("r1") - n1 * (n1 + 1) / 2
    centred = w - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((big + 1) - F.col("tie") / (big * (big - 1))))
    z = (centred - F.signum(centred) * 0.5) / F.nullif(sigma, F.lit(0.0))
    exact = (n1 < EXACT_BELOW) & (n2 < EXACT_BELOW) & (F.col("tie") == 0)
    return wide.select(
        *strata, "group1", "group2", n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
        w.alias("statistic"), z.alias("z"), exact.alias("exact"),
    )


def wilcoxon(df: DataFrame, strata: Sequence[str], value: str, level: str, exact: bool | None = None) -> DataFrame:
    """Two-sample rank-sum test per stratum holding exactly two levels.

    ``exact=False`` forces the normal approximation with tie and continuity correction; ``None``
    takes the exact distribution for small untied strata and the approximation otherwise.
    """
    sums = level_rank_sums(df, strata, value, level).withColumnRenamed(level, "level")
    return _with_rank_sum_p(_rank_sum(sums, strata), exact)


def _with_rank_sum_p(res: DataFrame, exact: bool | None) -> DataFrame:
    normal = tails.p_normal_two_sided(F.col("z"))
    if exact is False:
        return res.withColumn("p_value", normal).drop("exact")
    use = F.col("exact") if exact is None else F.lit(True)
    guard = lambda c: F.when(use, F.col(c))
    return (
        res.withColumns(
            {"_pn": normal, "_pe": tails.p_rank_sum_exact(guard("statistic"), guard("n1"), guard("n2"))}
        )
        .withColumn("p_value", F.coalesce("_pe", "_pn"))
        .drop("_pn", "_pe")
    )


def pairwise_wilcoxon(
    df: DataFrame, strata: Sequence[str], value: str, level: str, gate: float | None = 0.05, exact: bool | None = None
) -> DataFrame:
    """Rank-sum test of every level pair, re-ranked inside the pair, BH within the stratum.

    With ``gate`` only strata whose Kruskal-Wallis p is below it are tested. A stratum with a single level has no
    pair and so no row. The data are read once and
    collapsed to (level, value) counts, which both the gate and the pair ranking use; for the
    pairs they are copied once per other level of the design.
    """
    strata = list(strata)
    counts = checkpointed(
        df.where(F.col(value).isNotNull()).groupBy(*strata, level, value).agg(F.count("*").alias("_n"))
    )
    if gate is not None:
        sums = level_rank_sums(counts, strata, value, level, weight="_n")
        passed = _kruskal_from_sums(sums, strata).where(F.col("p_value") < gate).select(*strata)
        counts = join_null_safe(counts, passed, strata)
    levels = counts.groupBy(*strata).agg(F.collect_set(level).alias("_levels"))  # design levels only
    key = lambda c: F.struct(F.lower(c), c)
    spread = (
        join_null_safe(counts, levels, strata)
        .withColumn("_other", F.explode(F.array_remove("_levels", F.col(level))))
        .withColumns(
            {
                "_a": F.when(key(F.col(level)) < key(F.col("_other")), F.col(level)).otherwise(F.col("_other")),
                "_b": F.when(key(F.col(level)) < key(F.col("_other")), F.col("_other")).otherwise(F.col(level)),
                "level": F.col(level),
            }
        )
    )
    pair = [*strata, "_a", "_b"]
    sums = (
        rank_table(spread, pair, value, by=["level"], weight="_n")
        .groupBy(*pair, "level")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("midrank")).alias("rank_sum"), _tie_term().alias("tie"))
    )
    res = _with_rank_sum_p(_rank_sum(sums, pair), exact).drop("_a", "_b")
    # the later level is reported first, so W belongs to it
    res = res.select(
        *strata, F.col("group2").alias("group1"), F.col("group1").alias("group2"), F.col("n2").alias("n1"),
        F.col("n1").alias("n2"), (F.col("n1") * F.col("n2") - F.col("statistic")).alias("statistic"), "p_value",
    )
    return adjust_bh(res, strata, "p_value")


def welch_t(
    df: DataFrame, strata: Sequence[str], value: str, level: str, level_a, level_b, pooled: bool = False
) -> DataFrame:
    """Two-sample t per stratum in one aggregation; Welch unless ``pooled``."""
    pick = lambda lv: F.when(F.col(level) == lv, F.col(value))
    agg = df.where(F.col(level).isin(level_a, level_b)).groupBy(*strata).agg(
        *[
            f(pick(lv)).alias(f"{nm}{i}")
            for i, lv in ((1, level_a), (2, level_b))
            for nm, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))
        ]
    ).where("n1 > 1 AND n2 > 1")
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "v1", "v2"))
    if pooled:
        dof = n1 + n2 - 2
        se = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        se = F.sqrt(a + b)
        dof = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return agg.select(
        *strata, "n1", "n2", (F.col("m1") - F.col("m2")).alias("estimate"),
        ((F.col("m1") - F.col("m2")) / F.nullif(se, F.lit(0.0))).alias("statistic"), dof.alias("df"),
    ).withColumn("p_value", tails.p_t(F.col("statistic"), F.col("df")))


def _cells(df: DataFrame, strata: Sequence[str], value: str, a: str, b: str) -> DataFrame:
    return (
        usable(df, value, a, b)
        .groupBy(*strata, a, b)
        .agg(
            F.count("*").alias("n"),
            F.avg(value).alias("mean"),
            F.coalesce(F.var_samp(value) * (F.count("*") - 1), F.lit(0.0)).alias("within"),
        )
    )


def _anova_fit(cells: pd.DataFrame, a: str, b: str) -> list[tuple[str, int, float]]:
    """Sequential sums of squares of one small cell table: A, B given A, interaction, residual."""
    n, mean = cells["n"].to_numpy(float), cells["mean"].to_numpy(float)
    da = pd.get_dummies(cells[a], drop_first=True).to_numpy(float)
    db = pd.get_dummies(cells[b], drop_first=True).to_numpy(float)
    one = np.ones((len(cells), 1))
    root = np.sqrt(n)[:, None]

    def fit(x):
        coef, _, rank, _ = np.linalg.lstsq(x * root, mean * root[:, 0], rcond=None)
        r = mean - x @ coef
        return float(np.sum(n * r * r)), int(rank)

    s0, r0 = fit(one)
    s1, r1 = fit(np.hstack([one, da]))
    s2, r2 = fit(np.hstack([one, da, db]))
    cells_n = len(cells)
    return [
        (a, r1 - r0, max(0.0, s0 - s1)),
        (b, r2 - r1, max(0.0, s1 - s2)),
        (f"{a}:{b}", cells_n - r2, s2),
        ("Residuals", int(n.sum()) - cells_n, float(cells["within"].sum())),
    ]


def anova_two_way(df: DataFrame, strata: Sequence[str], value: str, a: str, b: str) -> DataFrame:
    """Two-way ANOVA with interaction, sequential sums of squares, any cell sizes.

    Rows reduce to one line per design cell; only that cell table is fitted per stratum.
    """
    strata = list(strata)
    cells = _cells(df, strata, value, a, b)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in strata)
    schema = (fields + ", " if fields else "") + "term string, df long, sum_sq double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(_anova_fit(pdf.sort_values([a, b]), a, b), columns=["term", "df", "sum_sq"])
        for i, s in enumerate(strata):
            rows.insert(i, s, pdf[s].iloc[0])
        return rows

    table = cells.groupBy(*strata).applyInPandas(fit, schema)
    resid = table.where("term = 'Residuals'").select(
        *strata, F.col("df").alias("_rdf"), (F.col("sum_sq") / F.col("df")).alias("_mse")
    )
    keys = strata or ["_all"]
    if not strata:
        table, resid = table.withColumn("_all", F.lit(1)), resid.withColumn("_all", F.lit(1))
    both = join_null_safe(table, resid, keys)
    ms = F.col("sum_sq") / F.col("df")
    effect = F.col("term") != "Residuals"
    return both.select(
        *strata, "term", "df", "sum_sq", ms.alias("mean_sq"), F.when(effect, ms / F.col("_mse")).alias("statistic"),
        F.when(effect, F.col("df")).alias("_d1"), "_rdf",
    ).withColumn("p_value", tails.p_f(F.col("statistic"), F.col("_d1"), F.col("_rdf"))).drop("_d1", "_rdf")


def tukey_hsd(df: DataFrame, strata: Sequence[str], value: str, a: str, b: str) -> DataFrame:
    """Tukey comparisons of the interaction cells; ``contrast`` is ``later-earlier`` cell."""
    strata = list(strata)
    cells = _cells(df, strata, value, a, b).withColumn("cell", F.concat_ws(":", a, b))
    resid = cells.groupBy(*strata).agg(
        (F.sum("within") / (F.sum("n") - F.count("*"))).alias("mse"),
        (F.sum("n") - F.count("*")).alias("df"),
        F.count("*").alias("k"),
    )
    side = lambda s: cells.select(
        *strata, F.col(a).alias(f"a{s}"), F.col(b).alias(f"b{s}"), F.col("cell").alias(f"c{s}"),
        F.col("n").alias(f"n{s}"), F.col("mean").alias(f"m{s}"),
    )
    lo, hi = side("1"), side("2")
    keys = strata or ["_all"]
    if not strata:
        lo, hi, resid = (d.withColumn("_all", F.lit(1)) for d in (lo, hi, resid))
    # cells vary the first factor fastest
    key = lambda s: F.struct(F.lower(f"b{s}"), F.col(f"b{s}"), F.lower(f"a{s}"), F.col(f"a{s}"))
    pairs = join_null_safe(join_null_safe(lo, hi, keys).where(key("1") < key("2")), resid, keys)
    q = F.abs(F.col("m2") - F.col("m1")) / F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    return pairs.select(
        *strata, F.concat_ws("-", "c2", "c1").alias("contrast"), (F.col("m2") - F.col("m1")).alias("estimate"),
        q.alias("statistic"), "k", "df",
    ).withColumn("p_adj", tails.p_studentized_range(F.col("statistic"), F.col("k"), F.col("df"))).drop("k")


def spearman(df: DataFrame, strata: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman rho per stratum of any size, pairs with a NULL dropped first."""
    strata = list(strata)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*strata, x, y)
    ranked = pairs
    for c, r in ((x, "_rx"), (y, "_ry")):
        t = rank_table(pairs, strata, c).select(
            *strata, c, F.col("midrank").alias(r), (F.col("ties") > 1).alias(f"{r}t")
        )
        ranked = join_null_safe(ranked, t, [*strata, c])
    return ranked.groupBy(*strata).agg(
        F.count("*").alias("n"), F.corr("_rx", "_ry").alias("estimate"),
        (F.bool_or("_rxt") | F.bool_or("_ryt")).alias("ties"),
    ).withColumn("p_value", tails.p_spearman(F.col("estimate"), F.col("n"), F.col("ties")))


def correlation_calls(df: DataFrame, estimate: str = "estimate", q: str = "q") -> DataFrame:
    """Size, fill value and direction of each correlation at the 0.05 level."""
    return df.withColumns(
        {
            "estimate_size": F.abs(estimate),
            "estimate_fill": F.when(F.col(q) <= 0.05, F.col(estimate)).when(F.col(q).isNotNull(), F.lit(0.0)),
            "call": F.when(F.col(q) > 0.05, "ns").when(F.col(estimate) > 0, "positive").when(
                F.col(estimate) < 0, "negative"
            ).when(F.col(q).isNotNull(), "ns"),
        }
    )


_TIE_RUN = 4096  # positions of one value that are handled together
# polynomial corrections of the two largest weights (fixed values)
_SW1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_SW2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
# polynomials of the null distribution of W (fixed values)
_SW_G = (-2.273, 0.459)
_SW_C3, _SW_C4 = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_C5, _SW_C6 = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _poly(cs, x: Column) -> Column:
    out = F.lit(float(cs[-1]))
    for c in reversed(cs[:-1]):
        out = out * x + F.lit(float(c))
    return out


def shapiro_wilk(df: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Shapiro-Wilk W and p for strata of 3 rows and more; smaller ones are reported with NULL W.

    The ordered rows are never in one place: the positions of a value come from the rank table, and a value
    held by many rows is cut into runs of positions before they are expanded. The p-value uses the published
    approximation, which was fitted on up to 5,000 rows; beyond, it is extrapolated.
    """
    strata = list(strata)
    rows = usable(df, value).select(*strata, F.col(value).cast("double").alias("x"))
    size = rows.groupBy(*strata).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_samp("x") * (F.count("*") - 1)).alias("ss")
    )
    valid = size.where("n >= 3")
    spans = rank_table(rows, strata, "x").select(*strata, "x", F.col("below").alias("_lo"), F.col("maxrank").alias("_hi"))
    runs = spans.withColumn("_at", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"), F.lit(_TIE_RUN).cast("long"))))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = attach(runs.repartition(width, "_at", "x"), valid, strata, "inner").withColumn(
        "i", F.explode(F.sequence(F.col("_at"), F.least(F.col("_hi"), F.col("_at") + _TIE_RUN - 1)))
    )
    n = F.col("n").cast("double")
    scored = placed.withColumn("_p", (F.col("i") - 0.375) / (n + 0.25)).withColumn("m", tails.probit(F.col("_p")))
    sums = scored.groupBy(*strata).agg(
        F.first("n").alias("n"), F.first("ss").alias("ss"), F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("m") * F.col("x")).alias("mx"),
        F.max(F.when(F.col("i") == 1, F.col("x"))).alias("x1"), F.max(F.when(F.col("i") == 2, F.col("x"))).alias("x2"),
        F.max(F.when(F.col("i") == F.col("n"), F.col("x"))).alias("xn"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("x"))).alias("xm"),
        F.max(F.when(F.col("i") == F.col("n"), F.col("m"))).alias("mn"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("mm1"),
    )
    mn, mm, mm1 = F.col("mn"), F.col("mm"), F.col("mm1")
    u = 1 / F.sqrt(n)
    an = mn / F.sqrt(mm) + _poly(_SW1, u)
    am = mm1 / F.sqrt(mm) + _poly(_SW2, u)
    sums = sums.withColumns({"an": an, "am": am})
    an, am = F.col("an"), F.col("am")
    top, second = F.col("xn") - F.col("x1"), F.col("xm") - F.col("x2")
    phi5 = (mm - 2 * mn * mn - 2 * mm1 * mm1) / (1 - 2 * an * an - 2 * am * am)
    phi4 = (mm - 2 * mn * mn) / (1 - 2 * an * an)
    inner5 = F.col("mx") - mn * top - mm1 * second
    inner4 = F.col("mx") - mn * top
    score = (
        F.when(F.col("n") == 3, F.lit(math.sqrt(0.5)) * top)
        .when(F.col("n") <= 5, an * top + inner4 / F.sqrt(phi4))
        .otherwise(an * top + am * second + inner5 / F.sqrt(phi5))
    )
    # W says nothing about a stratum of one value, whose sum of squares may be a rounding error
    w = F.when(F.col("xn") > F.col("x1"), F.least(score * score / F.nullif(F.col("ss"), F.lit(0.0)), F.lit(1.0)))
    res = sums.withColumn("w", w)
    lw, ln = F.log1p(-F.col("w")), F.log(n)
    small = n <= 11
    g = _poly(_SW_G, n)
    mu = F.when(small, _poly(_SW_C3, n)).otherwise(_poly(_SW_C5, ln))
    sd = F.exp(F.when(small, _poly(_SW_C4, n)).otherwise(_poly(_SW_C6, ln)))
    yy = F.when(small, -F.log(g - lw)).otherwise(lw)
    p3 = F.greatest(
        F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.lit(math.asin(math.sqrt(0.75)))), F.lit(0.0)
    )
    z = (yy - mu) / sd
    res = res.withColumn("_z", z).withColumn("_two", tails.p_normal_two_sided(F.col("_z")))
    upper = F.when(F.col("_z") >= 0, F.col("_two") / 2).otherwise(1 - F.col("_two") / 2)
    # beyond the range of the small-sample transform the p-value is zero
    upper = F.when(small & (lw >= g), F.lit(0.0)).otherwise(upper)
    done = res.select(
        *strata, F.col("w").alias("statistic"), F.when(F.col("n") == 3, p3).otherwise(upper).alias("p_value")
    )
    return join_null_safe(size.select(*strata, "n"), done, strata, "left")


def boxplot_summary(df: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Hinges, 1.5 IQR whisker ends and outlier count per stratum."""
    strata = list(strata)
    q = quantiles(df, strata, value, {"lower": 0.25, "middle": 0.5, "upper": 0.75})
    iqr = 1.5 * (F.col("upper") - F.col("lower"))
    inside = F.col(value).between(F.col("lower") - iqr, F.col("upper") + iqr)
    rows = attach(df.where(F.col(value).isNotNull()).select(*strata, value), q, strata)
    return rows.groupBy(*strata).agg(
        F.first("n").alias("n"), F.first("lower").alias("lower"), F.first("middle").alias("middle"),
        F.first("upper").alias("upper"), F.min(F.when(inside, F.col(value))).alias("ymin"),
        F.max(F.when(inside, F.col(value))).alias("ymax"), F.count_if(~inside).alias("n_outliers"),
    )


def confidence_ellipse(df: DataFrame, strata: Sequence[str], x: str, y: str, level: float = 0.95) -> DataFrame:
    """Mean, axes and angle of the normal confidence ellipse of a stratum's mean."""
    agg = df.groupBy(*strata).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("sxx"),
        F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"),
    ).where("n > 2")
    half, diff = (F.col("sxx") + F.col("syy")) / 2, (F.col("sxx") - F.col("syy")) / 2
    root = F.sqrt(diff * diff + F.col("sxy") * F.col("sxy"))

    # the quantile of F with 2 and m degrees of freedom is m / 2 * ((1 - level)^(-2 / m) - 1)
    m = F.col("n") - 1
    scale = m * F.expm1(-2 * math.log(1 - level) / m) / F.col("n")
    return agg.withColumns({"l1": half + root, "l2": F.greatest(half - root, F.lit(0.0))}).withColumn(
        "_s", scale
    ).select(
        *strata, "n", "mean_x", "mean_y", "sxx", "syy", "sxy", "l1", "l2",
        F.sqrt(F.col("l1") * F.col("_s")).alias("semi_major"), F.sqrt(F.col("l2") * F.col("_s")).alias("semi_minor"),
        F.atan2(F.col("l1") - F.col("sxx"), F.col("sxy")).alias("angle"),
    )


def baseline_fold_change(
    df: DataFrame, strata: Sequence[str], value: str, level: str, baseline, name: str = "fold_change"
) -> DataFrame:
    """Each value over the mean of the baseline level of its stratum (an aggregate joined back)."""
    base = df.where(F.col(level) == baseline).groupBy(*strata).agg(F.avg(value).alias("_base"))
    return attach(df, base, strata).withColumn(
        name, F.col(value) / F.nullif(F.col("_base"), F.lit(0.0))
    ).drop("_base")
