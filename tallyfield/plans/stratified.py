"""Stratified tests as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import stats
from ..proxies import lines, measures, samples, table
from .registry import CTE, query, with_tables
from .sqltext import bh, chi2_sf, midrank, normal_two_sided, probit, t_two_sided


def _line_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Line length by language inside each source: many ties, unequal groups."""
    lang = table(spark, d, "documents").select("doc_id", "lang")
    return lines(spark, d).join(lang, "doc_id").select("sample", "lang", F.length("seq").alias("len"))


_LENGTHS = CTE["lines"] + """, w AS (SELECT sample AS stratum, lang AS level, CAST(length(seq) AS DOUBLE) AS v
    FROM lines JOIN documents USING (doc_id))"""
_ORDERS = "w AS (SELECT o_orderstatus AS stratum, o_orderpriority AS level, o_totalprice AS v FROM orders)"

_RANKED = f"""
    r AS (SELECT stratum, level, v, {midrank('v', 'stratum')} AS rk,
            count(*) OVER (PARTITION BY stratum, v) AS t FROM w),
    lv AS (SELECT stratum, level, count(*) AS n, sum(rk) AS rs,
             sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r GROUP BY 1, 2),
    tot AS (SELECT stratum, CAST(sum(n) AS DOUBLE) AS nn, count(*) AS k, sum(rs * rs / n) AS s, sum(tie) AS tie
            FROM lv GROUP BY 1),
    kw AS (SELECT stratum, CAST(nn AS BIGINT) AS n, k - 1 AS df,
             (12 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - tie / (nn * nn * nn - nn)) AS h FROM tot)"""


def _kw_sql(source: str) -> str:
    return (
        f"WITH {source}, {_RANKED} SELECT stratum, n, round(h, 6) AS statistic, df, "
        f"round({chi2_sf('h', 'df')}, 6) AS p_value FROM kw"
    )


def _round(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("kruskal_wallis", _kw_sql(_ORDERS))
def kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.kruskal_wallis(measures(spark, d), ["stratum"], "value", "cohort"), "statistic", "p_value")


@query("stratified_test", _kw_sql(_LENGTHS))
def stratified_test(spark: SparkSession, d: str) -> DataFrame:
    rows = _line_lengths(spark, d).withColumnRenamed("sample", "stratum")
    return _round(stats.kruskal_wallis(rows, ["stratum"], "len", "lang"), "statistic", "p_value")


@query(
    "join_level_pairs",
    """WITH l AS (SELECT o_orderstatus AS stratum, o_orderpriority AS cohort, count(*) AS size FROM orders
         GROUP BY 1, 2)
       SELECT a.stratum, a.cohort AS level_a, b.cohort AS level_b, a.size AS size_a, b.size AS size_b
       FROM l a JOIN l b ON a.stratum = b.stratum AND lower(a.cohort) < lower(b.cohort)""",
)
def join_level_pairs(spark: SparkSession, d: str) -> DataFrame:
    sizes = measures(spark, d).groupBy("stratum", "cohort").agg(F.count("*").alias("size"))
    return stats.level_pairs(sizes, ["stratum"], "cohort", ["size"])


@query(
    "dunn_test",
    f"""WITH {_LENGTHS}, {_RANKED},
        z AS (SELECT a.stratum, a.level || ' - ' || b.level AS comparison,
                (a.rs / a.n - b.rs / b.n) / sqrt((nn * (nn + 1) / 12 - tot.tie / (12 * (nn - 1)))
                  * (1.0 / a.n + 1.0 / b.n)) AS z
              FROM lv a JOIN lv b ON a.stratum = b.stratum AND a.level < b.level JOIN tot ON tot.stratum = a.stratum),
        p AS (SELECT *, {normal_two_sided('z')} AS p FROM z),
        n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, comparison) AS rn,
                count(*) OVER (PARTITION BY stratum) AS m FROM p)
        SELECT stratum, comparison, round(z, 6) AS statistic, round(p, 6) AS p_value,
          round({bh('p', 'stratum', 'comparison')}, 6) AS p_adj FROM n""",
)
def dunn_test(spark: SparkSession, d: str) -> DataFrame:
    rows = _line_lengths(spark, d).withColumnRenamed("sample", "stratum")
    return _round(stats.dunn_test(rows, ["stratum"], "len", "lang"), "statistic", "p_value", "p_adj")


def _rank_sum_sql(strata: str) -> str:
    """From ``r(strata, level, rk, t)``: W of the first level and the normal p."""
    return f"""
    s AS (SELECT {strata}, min(level) AS group1, max(level) AS group2,
            CAST(count(*) FILTER (first) AS BIGINT) AS n1, CAST(count(*) FILTER (NOT first) AS BIGINT) AS n2,
            sum(rk) FILTER (first) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS tie
          FROM (SELECT *, level = min(level) OVER (PARTITION BY {strata}) AS first FROM r) GROUP BY {strata}),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS w,
            sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sigma FROM s),
    x AS (SELECT *, (w - n1 * n2 / 2.0 - sign(w - n1 * n2 / 2.0) * 0.5) / sigma AS z FROM u WHERE n1 > 0 AND n2 > 0)"""


@query(
    "wilcoxon_normal",
    f"""WITH w AS (SELECT l_suppkey AS stratum, l_linestatus AS level, l_quantity AS v FROM lineitem),
        r AS (SELECT stratum, level, v, {midrank('v', 'stratum')} AS rk,
                count(*) OVER (PARTITION BY stratum, v) AS t FROM w), {_rank_sum_sql('stratum')}
        SELECT stratum, group1, group2, n1, n2, round(w, 6) AS statistic, round(z, 6) AS z,
          round({normal_two_sided('z')}, 6) AS p_value FROM x""",
)
def wilcoxon_normal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stratum"), "l_linestatus", "l_quantity")
    return _round(
        stats.wilcoxon(rows, ["stratum"], "l_quantity", "l_linestatus", exact=False), "statistic", "z", "p_value"
    )


@query(
    "wilcoxon_exact",
    with_tables("samples", recursive=True)
    + f""", w AS (SELECT age AS stratum, diet AS level, s_acctbal AS v FROM samples JOIN supplier ON sample = s_suppkey),
        r AS (SELECT stratum, level, v, {midrank('v', 'stratum')} AS rk,
                count(*) OVER (PARTITION BY stratum, v) AS t FROM w), {_rank_sum_sql('stratum')},
        ways(r, j, s, c) AS (
          SELECT 0, 0, 0, CAST(1 AS DOUBLE)
          UNION ALL
          SELECT r + 1, j + d, s + d * (r + 1), sum(c) FROM ways, (VALUES (0), (1)) t(d)
          WHERE r < (SELECT max(n1 + n2) FROM s) GROUP BY 1, 2, 3),
        cdf AS (SELECT r AS big, j, s - j * (j + 1) // 2 AS w,
                  sum(c) OVER (PARTITION BY r, j ORDER BY s) / sum(c) OVER (PARTITION BY r, j) AS p FROM ways)
        SELECT stratum, group1, group2, n1, n2, x.w AS statistic, round(z, 6) AS z, true AS exact,
          round(least(1.0, 2 * CASE WHEN x.w > n1 * n2 / 2.0 THEN 1 - coalesce(lo.p, 0) ELSE hi.p END), 6) AS p_value
        FROM x JOIN cdf hi ON hi.big = n1 + n2 AND hi.j = n1 AND hi.w = x.w
        LEFT JOIN cdf lo ON lo.big = n1 + n2 AND lo.j = n1 AND lo.w = x.w - 1""",
)
def wilcoxon_exact(spark: SparkSession, d: str) -> DataFrame:
    bal = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), "s_acctbal")
    rows = samples(spark, d).join(bal, "sample").withColumnRenamed("age", "stratum")
    # strata over the exact size take the normal path by themselves
    return _round(stats.wilcoxon(rows, ["stratum"], "s_acctbal", "diet"), "z", "p_value")


@query(
    "pairwise_wilcoxon",
    f"""WITH {_LENGTHS}, {_RANKED.replace(' r AS', ' r0 AS').replace('FROM r GROUP', 'FROM r0 GROUP')},
        gated AS (SELECT stratum FROM kw WHERE {chi2_sf('h', 'df')} < 0.05),
        pr AS (SELECT a.stratum, a.level AS la, b.level AS lb FROM lv a JOIN lv b
                 ON a.stratum = b.stratum AND a.level < b.level WHERE a.stratum IN (SELECT stratum FROM gated)),
        wp AS (SELECT pr.stratum, la, lb, w.level, w.v FROM pr JOIN w ON w.stratum = pr.stratum
                 AND w.level IN (la, lb)),
        r AS (SELECT stratum, la, lb, level, {midrank('v', 'stratum, la, lb')} AS rk,
                count(*) OVER (PARTITION BY stratum, la, lb, v) AS t FROM wp), {_rank_sum_sql('stratum, la, lb')},
        p AS (SELECT *, {normal_two_sided('z')} AS p FROM x),
        n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, la, lb) AS rn,
                count(*) OVER (PARTITION BY stratum) AS m FROM p)
        SELECT stratum, group2 AS group1, group1 AS group2, n2 AS n1, n1 AS n2,
          round(n1 * n2 - w, 6) AS statistic, round(p, 6) AS p_value,
          round({bh('p', 'stratum', 'lb')}, 6) AS p_adj FROM n""",
)
def pairwise_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    rows = _line_lengths(spark, d).withColumnRenamed("sample", "stratum")
    res = stats.pairwise_wilcoxon(rows, ["stratum"], "len", "lang", gate=0.05, exact=False)
    return _round(res, "statistic", "p_value", "p_adj")


def _welch_sql(pooled: bool) -> str:
    if pooled:
        se = "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))"
        dof = "CAST(n1 + n2 - 2 AS DOUBLE)"
    else:
        se = "sqrt(v1 / n1 + v2 / n2)"
        dof = "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"
    return f"""WITH a AS (SELECT l_suppkey AS stratum, count(*) FILTER (l_linestatus = 'F') AS n1,
            count(*) FILTER (l_linestatus = 'O') AS n2, avg(l_quantity) FILTER (l_linestatus = 'F') AS m1,
            avg(l_quantity) FILTER (l_linestatus = 'O') AS m2, var_samp(l_quantity) FILTER (l_linestatus = 'F') AS v1,
            var_samp(l_quantity) FILTER (l_linestatus = 'O') AS v2 FROM lineitem GROUP BY 1),
          t AS (SELECT *, (m1 - m2) / {se} AS t, {dof} AS dof FROM a)
          SELECT stratum, n1, n2, round(m1 - m2, 6) AS estimate, round(t, 6) AS statistic, round(dof, 4) AS df,
            round({t_two_sided('t', 'dof')}, 6) AS p_value FROM t"""


def _t_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stratum"), "l_linestatus", "l_quantity")


@query("welch_t", _welch_sql(False))
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    res = stats.welch_t(_t_rows(spark, d), ["stratum"], "l_quantity", "l_linestatus", "F", "O")
    return _round(res, "estimate", "statistic", "p_value").withColumn("df", F.round("df", 4))


@query("pooled_t", _welch_sql(True))
def pooled_t(spark: SparkSession, d: str) -> DataFrame:
    res = stats.welch_t(_t_rows(spark, d), ["stratum"], "l_quantity", "l_linestatus", "F", "O", pooled=True)
    return _round(res, "estimate", "statistic", "p_value").withColumn("df", F.round("df", 4))


_CELLS = """c AS (SELECT l_linenumber AS stratum, l_returnflag AS a, l_linestatus AS b, count(*) AS n,
      avg(l_quantity) AS m, var_samp(l_quantity) * (count(*) - 1) AS w FROM lineitem GROUP BY 1, 2, 3)"""


@query(
    "anova_two_way",
    f"""WITH {_CELLS},
        g AS (SELECT *, sum(n * m) OVER s / sum(n) OVER s AS gm, sum(n * m) OVER sa / sum(n) OVER sa AS am,
                CASE WHEN b = 'O' THEN 1.0 ELSE 0.0 END - sum(CASE WHEN b = 'O' THEN n ELSE 0 END) OVER sa
                  / CAST(sum(n) OVER sa AS DOUBLE) AS zr
              FROM c WINDOW s AS (PARTITION BY stratum), sa AS (PARTITION BY stratum, a)),
        q AS (SELECT stratum, CAST(sum(n) AS BIGINT) - count(*) AS rdf, sum(w) AS rss,
                sum(n * (am - gm) ** 2) AS ssa, sum(n * zr * m) ** 2 / sum(n * zr * zr) AS ssb,
                sum(n * (m - am) ** 2) AS within_a FROM g GROUP BY 1),
        l AS (SELECT stratum, 'l_returnflag' AS term, 2 AS df, ssa AS ss, rdf, rss FROM q
              UNION ALL SELECT stratum, 'l_linestatus', 1, ssb, rdf, rss FROM q
              UNION ALL SELECT stratum, 'l_returnflag:l_linestatus', 2, within_a - ssb, rdf, rss FROM q
              UNION ALL SELECT stratum, 'Residuals', rdf, rss, rdf, rss FROM q),
        f AS (SELECT *, CASE WHEN term <> 'Residuals' THEN (ss / df) / (rss / rdf) END AS f FROM l)
        SELECT stratum, term, CAST(df AS BIGINT) AS df, round(ss, 4) AS sum_sq, round(ss / df, 4) AS mean_sq,
          round(f, 6) AS statistic,
          round(CASE WHEN term = 'Residuals' THEN NULL WHEN df = 2 THEN pow(1 + 2 * f / rdf, -rdf / 2.0)
            ELSE {t_two_sided('sqrt(f)', 'rdf')} END, 6) AS p_value FROM f""",
)
def anova_two_way(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "stratum")
    res = stats.anova_two_way(rows, ["stratum"], "l_quantity", "l_returnflag", "l_linestatus")
    return _round(_round(res, "statistic", "p_value"), "sum_sq", "mean_sq", places=4)


@query(
    "tukey_hsd",
    f"""WITH {_CELLS},
        e AS (SELECT stratum, sum(w) / (sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df
              FROM c GROUP BY 1)
        SELECT x.stratum, y.a || ':' || y.b || '-' || x.a || ':' || x.b AS contrast, round(y.m - x.m, 6) AS estimate,
          round(abs(y.m - x.m) / sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n)), 6) AS statistic, df
        FROM c x JOIN c y ON x.stratum = y.stratum AND (x.b, x.a) < (y.b, y.a) JOIN e ON e.stratum = x.stratum""",
)
def tukey_hsd(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "stratum")
    res = stats.tukey_hsd(rows, ["stratum"], "l_quantity", "l_returnflag", "l_linestatus")
    # the studentized-range tail is checked by unit tests; SQL has no counterpart
    return _round(res, "estimate", "statistic").drop("p_adj")


def _range_tail(q: str, k: str, df: str) -> str:
    """Rows of ``t`` with the studentized-range tail ``p``: equal-step sums over the scale and the normal variable.

    The normal distribution function at a sum is 1/2 plus the density times the series x + x^3/3 + x^5/15 + ..
    """
    phi = "exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi())"
    cdf = (
        "CASE WHEN {x} > 9 THEN 1.0 ELSE 0.5 + " + phi + " * list_reduce(range(150, -1, -1)::DOUBLE[], "
        "lambda acc, step: 1 + acc * ({x}) * ({x}) / (2 * step + 3), 1.0) * ({x}) END"
    )
    return f"""zs AS MATERIALIZED (SELECT j * 0.1 AS z, {phi.format(x='j * 0.1')} AS f, {cdf.format(x='j * 0.1')} AS c FROM range(-80, 81) r(j)),
        ds AS (SELECT DISTINCT CAST({df} AS DOUBLE) AS v FROM t),
        ss AS MATERIALIZED (
          SELECT v, 1 + i / (5 * sqrt(2 * v)) AS s, 1 / (5 * sqrt(2 * v)) AS h FROM ds, range(-45, 51) r(i) WHERE 1 + i / (5 * sqrt(2 * v)) > 0),
        sw AS MATERIALIZED (SELECT v, s, h * exp(v / 2 * ln(v) - lgamma(v / 2) - (v / 2 - 1) * ln(2) + (v - 1) * ln(s) - v * s * s / 2) AS w FROM ss),
        spots AS (SELECT t.*, sw.w, zs.f, zs.c, zs.z + {q} * sw.s AS x FROM t JOIN sw ON sw.v = {df}, zs),
        tail AS (SELECT * EXCLUDE (w, f, c, x), 1 - sum(w * {k} * 0.1 * f * pow(({cdf.format(x='x')}) - c, {k} - 1)) AS p FROM spots GROUP BY ALL)"""


@query(
    "tukey_p_values",
    f"""WITH {_CELLS},
        e AS (SELECT stratum, sum(w) / (sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df, count(*) AS k FROM c GROUP BY 1),
        t AS (SELECT x.stratum, y.a || ':' || y.b || '-' || x.a || ':' || x.b AS contrast, y.m - x.m AS estimate,
                abs(y.m - x.m) / sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n)) AS q, df, k
              FROM c x JOIN c y ON x.stratum = y.stratum AND (x.b, x.a) < (y.b, y.a) JOIN e ON e.stratum = x.stratum),
        {_range_tail('q', 'k', 'df')}
        SELECT stratum, contrast, round(estimate, 6) AS estimate, round(greatest(least(p, 1.0), 0.0), 6) AS p_adj FROM tail""",
)
def tukey_p_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "stratum")
    return _round(
        stats.tukey_hsd(rows, ["stratum"], "l_quantity", "l_returnflag", "l_linestatus"), "estimate", "p_adj"
    ).select("stratum", "contrast", "estimate", "p_adj")


_SPEARMAN = f"""w AS (SELECT l_returnflag AS stratum, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    r AS (SELECT stratum, {midrank('x', 'stratum')} AS rx, {midrank('y', 'stratum')} AS ry FROM w),
    c AS (SELECT stratum, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1)"""


@query(
    "spearman_test",
    f"""WITH {_SPEARMAN.replace('l_extendedprice', 'l_discount')}
        SELECT stratum, n, round(rho, 6) AS estimate, true AS ties,
          round({t_two_sided('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')}, 6) AS p_value FROM c""",
)
def spearman_test(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "stratum")
    return _round(stats.spearman(rows, ["stratum"], "l_quantity", "l_discount"), "estimate", "p_value")


@query(
    "correlation_calls",
    f"""WITH {_SPEARMAN.replace('l_returnflag', 'l_suppkey')},
        p AS (SELECT *, {t_two_sided('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} AS p FROM c)
        SELECT stratum, round(rho, 6) AS estimate, round(abs(rho), 6) AS estimate_size,
          round(CASE WHEN p <= 0.05 THEN rho ELSE 0.0 END, 6) AS estimate_fill,
          CASE WHEN p > 0.05 THEN 'ns' WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS call FROM p""",
)
def correlation_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "stratum")
    res = stats.spearman(rows, ["stratum"], "l_quantity", "l_extendedprice").withColumnRenamed("p_value", "q")
    return _round(stats.correlation_calls(res), "estimate", "estimate_size", "estimate_fill").select(
        "stratum", "estimate", "estimate_size", "estimate_fill", "call"
    )


@query(
    "shapiro_wilk",
    f"""WITH w AS (SELECT c_mktsegment AS stratum, c_acctbal AS x FROM customer),
        o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY x) AS i,
                count(*) OVER (PARTITION BY stratum) AS n FROM w),
        q AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o),
        m AS (SELECT *, {probit('p')} AS m FROM q),
        s AS (SELECT *, sum(m * m) OVER (PARTITION BY stratum) AS mm,
                max(m) OVER (PARTITION BY stratum) AS mn, 1 / sqrt(n) AS u,
                max(m) FILTER (i = n - 1) OVER (PARTITION BY stratum) AS mk FROM m),
        a AS (SELECT *, mn / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.07119 * u ** 3 + 4.434685 * u ** 4
                  - 2.706056 * u ** 5 AS an,
                mk / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4
                  - 3.582633 * u ** 5 AS ak FROM s),
        b AS (SELECT *, CASE WHEN i = 1 THEN -an WHEN i = 2 THEN -ak WHEN i = n THEN an WHEN i = n - 1 THEN ak
                ELSE m / sqrt((mm - 2 * mn ** 2 - 2 * mk ** 2) / (1 - 2 * an ** 2 - 2 * ak ** 2)) END AS wt FROM a),
        z AS (SELECT stratum, n, sum(wt * x) ** 2 / (var_samp(x) * (n - 1)) AS w FROM b GROUP BY 1, 2),
        t AS (SELECT *, (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * ln(n) ** 2 + 0.0038915 * ln(n) ** 3))
                / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * ln(n) ** 2) AS zz FROM z)
        SELECT stratum, n, round(w, 6) AS statistic,
          round(CASE WHEN zz >= 0 THEN {normal_two_sided('zz')} / 2 ELSE 1 - {normal_two_sided('zz')} / 2 END, 6)
            AS p_value FROM t""",
)
def shapiro_wilk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "stratum")
    return _round(stats.shapiro_wilk(rows, ["stratum"], "c_acctbal"), "statistic", "p_value")


@query(
    "tail_probabilities",
    f"""WITH a AS (SELECT s_suppkey AS id, s_acctbal / 2000 AS x, CAST(s_nationkey + 2 AS DOUBLE) AS df FROM supplier)
        SELECT id, round({chi2_sf('(abs(x) * 4)', 'df')}, 6) AS p_chi2, round({normal_two_sided('x')}, 6) AS p_normal,
          round({t_two_sided('x', 'df')}, 6) AS p_t, round(pow(1 + 2 * abs(x) / df, -df / 2), 6) AS p_f FROM a""",
)
def tail_probabilities(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 2000).alias("x"), (F.col("s_nationkey") + 2).alias("df")
    )
    x, df = F.col("x"), F.col("df")
    return a.select(
        "id",
        F.round(tails.p_chi2(F.abs(x) * 4, df), 6).alias("p_chi2"),
        F.round(tails.p_normal_two_sided(x), 6).alias("p_normal"),
        F.round(tails.p_t(x, df), 6).alias("p_t"),
        F.round(tails.p_f(F.abs(x), F.lit(2), df), 6).alias("p_f"),
    )
