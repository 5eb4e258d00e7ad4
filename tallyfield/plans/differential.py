"""Differential abundance and association queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abundance as A
from ..operators import diversity
from ..proxies import analytes, counts, genus_counts, samples, table, taxonomy
from .registry import query, with_tables
from .sqltext import bh, f_sf, inverse, midrank, t_two_sided

_DESIGN = """design AS (SELECT sample, CAST(1 AS DOUBLE) AS x0, CAST(challenge = 'sal' AS DOUBLE) AS x1,
      CAST(diet = 'gos' AS DOUBLE) AS x2, CAST(age AS DOUBLE) AS x3 FROM samples)"""


def _residual(j: int) -> str:
    """Column j of the design orthogonal to the other columns, by successive projection."""
    others = [k for k in range(4) if k != j]
    sql, cur = [], {k: f"x{k}" for k in range(4)}
    src = "design"
    for step, o in enumerate(others):
        left = [k for k in others[step + 1 :] + [j]]
        name = f"o{j}_{step}"
        keep = ", ".join(
            f"{cur[k]} - {cur[o]} * (sum({cur[k]} * {cur[o]}) OVER () / sum({cur[o]} * {cur[o]}) OVER ()) AS x{k}"
            for k in left
        )
        sql.append(f"{name} AS (SELECT sample, {keep} FROM {src})")
        src = name
    sql.append(f"r{j} AS (SELECT sample, x{j} AS r FROM {src})")
    return ", ".join(sql)


def _glm_sql(cells: str, prefix: str = "g") -> str:
    """Coefficients from a complete ``cells(sample, feature, y)`` by orthogonal regression per term."""
    parts = [_residual(j) for j in range(4)]
    ols = ", ".join(
        f"{prefix}b{j} AS (SELECT feature, sum(r * y) / sum(r * r) AS b, sum(r * r) AS rr, sum(r * y) AS ry "
        f"FROM {cells} JOIN r{j} USING (sample) GROUP BY 1)"
        for j in range(4)
    )
    fit = f"""{prefix}fit AS (SELECT c.feature, sum((y - b0.b * x0 - b1.b * x1 - b2.b * x2 - b3.b * x3) ** 2) AS rss,
          count(*) - 4 AS dof FROM {cells} c JOIN design USING (sample) JOIN {prefix}b0 b0 ON b0.feature = c.feature
          JOIN {prefix}b1 b1 ON b1.feature = c.feature JOIN {prefix}b2 b2 ON b2.feature = c.feature
          JOIN {prefix}b3 b3 ON b3.feature = c.feature GROUP BY 1)"""
    long = f"{prefix}long AS (" + " UNION ALL ".join(
        f"SELECT feature, '{t}' AS term, b AS estimate, sqrt(rss / dof / rr) AS se, dof "
        f"FROM {prefix}b{j} JOIN {prefix}fit USING (feature)"
        for j, t in enumerate(A.TERMS)
    ) + ")"
    test = (
        f"{prefix}test AS (SELECT *, estimate / se AS t, {t_two_sided('estimate / se', 'dof')} AS p FROM {prefix}long)"
    )
    holm = f"""{prefix}n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p, feature) AS rn,
          count(*) OVER (PARTITION BY term) AS m FROM {prefix}test),
        {prefix} AS (SELECT feature, term, estimate, se, t, p, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY term
          ORDER BY p, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM {prefix}n)"""
    return ", ".join([ols, fit, long, test, holm])


_BASES = ", ".join(_residual(j) for j in range(4))


def _grid(source: str) -> str:
    return f"""grid AS (SELECT s.sample, f.feature, coalesce(c.reads, 0) AS reads FROM samples s
        CROSS JOIN (SELECT DISTINCT feature FROM {source}) f
        LEFT JOIN {source} c ON c.sample = s.sample AND c.feature = f.feature)"""


_CLR = "clr AS (SELECT sample, feature, ln(reads + 0.5) - avg(ln(reads + 0.5)) OVER (PARTITION BY sample) AS y FROM grid)"


def _fractions(source: str, steps: int = 20, tol: float = 0.01) -> str:
    """CTEs up to ``fr(sample, fr)``: the model's sample bias by all alternating steps, of which the first settled one counts."""
    t = [
        f"""lc AS MATERIALIZED (SELECT sample, feature, ln(reads) AS y, [x0, x1, x2, x3] AS xs FROM {source} JOIN design USING (sample)
          WHERE reads > 0 AND feature IN (SELECT feature FROM {source} WHERE reads > 0 GROUP BY 1 HAVING count(*) > 4))""",
        "ll AS MATERIALIZED (SELECT sample, feature, y, unnest(range(0, 4)) AS i, unnest(xs) AS x FROM lc)",
        "fx AS MATERIALIZED (SELECT a.feature, a.i, b.i AS j, sum(a.x * b.x) AS v FROM ll a JOIN ll b USING (feature, sample) GROUP BY ALL)",
        inverse("fi", "fx", [0, 1, 2, 3], "feature"), "th0 AS MATERIALIZED (SELECT sample, 0.0 AS th FROM design)",
    ]
    for k in range(1, steps + 1):
        t += [
            f"""cf{k} AS MATERIALIZED (SELECT fi.feature, fi.i, sum(fi.v * q.v) AS b FROM fi JOIN (
                SELECT feature, i, sum(x * (y - th)) AS v FROM ll JOIN th{k - 1} USING (sample) GROUP BY 1, 2) q
                ON q.feature = fi.feature AND q.i = fi.j GROUP BY 1, 2)""",
            f"""th{k} AS MATERIALIZED (SELECT sample, avg(y - f) AS th FROM (SELECT sample, feature, any_value(y) AS y, sum(x * b) AS f
                FROM ll JOIN cf{k} USING (feature, i) GROUP BY 1, 2) GROUP BY 1)""",
        ]
    moves = " UNION ALL ".join(
        f"SELECT {k} AS k, max(abs(a.th - b.th)) AS d FROM th{k} a JOIN th{k - 1} b USING (sample)" for k in range(1, steps + 1)
    )
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM th{k}" for k in range(1, steps + 1))
    t.append(f"settled AS MATERIALIZED (SELECT coalesce(min(k), {steps}) AS k FROM ({moves}) WHERE d < {tol})")
    t.append(f"fr AS MATERIALIZED (SELECT sample, th AS fr FROM ({every}) WHERE k = (SELECT k FROM settled))")
    return ", ".join(t)


def _r(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "design_matrix",
    with_tables("samples")
    + f', {_DESIGN} SELECT sample, x0 AS "intercept", x1 AS "challengeSE", x2 AS dietgos, x3 AS age FROM design',
)
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.trial_design(samples(spark, d))


@query(
    "clr_transform",
    with_tables("samples", "counts")
    + f""", {_grid('counts')}, c AS (SELECT *, avg(ln(reads + 0.5)) OVER (PARTITION BY sample) AS m FROM grid)
         SELECT sample, feature, round(ln(reads + 0.5) - m, 6) AS clr, round(ln(0.5) - m, 6) AS absent
         FROM c WHERE reads > 0""",
)
def clr_transform(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.clr_transform(counts(spark, d), samples(spark, d)), "clr", "absent").drop("reads")


@query("dirichlet_clr_instances")
def dirichlet_clr_instances(spark: SparkSession, d: str) -> DataFrame:
    return A.dirichlet_clr_instances(genus_counts(spark, d), samples(spark, d), instances=128, seed=1216)


@query(
    "feature_glm",
    with_tables("samples", "counts")
    + f""", {_DESIGN}, {_BASES}, {_grid('counts')}, {_CLR}, {_glm_sql('clr')}
         SELECT feature, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(t, 5) AS statistic,
           round(p, 6) AS p_value, round(p_adj, 6) AS p_adj FROM g""",
)
def feature_glm(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    res = A.clr_glm(counts(spark, d), s, A.trial_design(s))
    return _r(res, "estimate", "se", "p_value", "p_adj").withColumn("statistic", F.round("statistic", 5))


@query("glm_over_instances")
def glm_over_instances(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    inst = A.dirichlet_clr_instances(genus_counts(spark, d), s, instances=128, seed=1216)
    return A.glm_over_instances(inst, A.trial_design(s))


@query("feature_effect_size")
def feature_effect_size(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    inst = A.dirichlet_clr_instances(genus_counts(spark, d), s, instances=128, seed=1216)
    return A.feature_effect_size(inst, A.trial_design(s))


def _mixture(steps: int = 100, tol: float = 1e-5) -> str:
    """CTEs from ``est(feature, term, n, beta, nu)`` up to ``bias(term, d, vd)``: all EM steps, of which the first settled counts."""
    t = ["""em0 AS MATERIALIZED (SELECT term, c AS d, least(lo - c, -1e-3) AS l1, greatest(hi - c, 1e-3) AS l2, sp AS k1, sp AS k2,
          0.75 AS p0, 0.125 AS p1, 0.125 AS p2, 0.0 AS vd FROM (
            SELECT term, (q1 + q3) / 2 AS c, lo, hi, greatest(((q3 - q1) / 1.349) ** 2, 1e-8) AS sp FROM (
              SELECT term, quantile_cont(beta, 0.125) AS lo, quantile_cont(beta, 0.25) AS q1, quantile_cont(beta, 0.75) AS q3,
                quantile_cont(beta, 0.875) AS hi FROM est GROUP BY 1)))"""]
    for k in range(1, steps + 1):
        t.append(f"""em{k} AS MATERIALIZED (
          SELECT term, sum(r0 / nu * beta + r1 / v1 * (beta - l1) + r2 / v2 * (beta - l2)) / sum(r0 / nu + r1 / v1 + r2 / v2) AS d,
            least(0.0, sum(r1 / v1 * (beta - d)) / greatest(sum(r1 / v1), 1e-12)) AS l1,
            greatest(0.0, sum(r2 / v2 * (beta - d)) / greatest(sum(r2 / v2), 1e-12)) AS l2,
            greatest(0.0, sum(r1 * ((beta - d - l1) ** 2 - nu)) / greatest(sum(r1), 1e-12)) AS k1,
            greatest(0.0, sum(r2 * ((beta - d - l2) ** 2 - nu)) / greatest(sum(r2), 1e-12)) AS k2,
            avg(r0) AS p0, avg(r1) AS p1, avg(r2) AS p2, 1 / sum(r0 / nu + r1 / v1 + r2 / v2) AS vd
          FROM (SELECT *, f0 / (f0 + f1 + f2 + 1e-300) AS r0, f1 / (f0 + f1 + f2 + 1e-300) AS r1, f2 / (f0 + f1 + f2 + 1e-300) AS r2
                FROM (SELECT *, p0 * exp(-1 * pow(beta - d, 2) / (2 * nu)) / sqrt(nu) AS f0,
                        p1 * exp(-1 * pow(beta - d - l1, 2) / (2 * v1)) / sqrt(v1) AS f1,
                        p2 * exp(-1 * pow(beta - d - l2, 2) / (2 * v2)) / sqrt(v2) AS f2
                      FROM (SELECT term, beta, nu, d, l1, l2, p0, p1, p2, nu + k1 AS v1, nu + k2 AS v2 FROM est JOIN em{k - 1} USING (term))))
          GROUP BY 1)""")
    moves = " UNION ALL ".join(
        f"SELECT {k} AS k, max(abs(a.d - b.d)) AS m FROM em{k} a JOIN em{k - 1} b USING (term)" for k in range(1, steps + 1)
    )
    every = " UNION ALL ".join(f"SELECT {k} AS k, term, d, vd FROM em{k}" for k in range(1, steps + 1))
    t.append(f"em_end AS MATERIALIZED (SELECT coalesce(min(k), {steps}) AS k FROM ({moves}) WHERE m < {tol})")
    t.append(f"bias AS MATERIALIZED (SELECT term, d, vd FROM ({every}) WHERE k = (SELECT k FROM em_end))")
    return ", ".join(t)


def _corrected_sql(source: str, steps: int = 20) -> str:
    """CTEs up to ``bc(feature, term, lfc, se, w, p, q)`` of the bias-corrected model."""
    coefficients = " UNION ALL ".join(f"SELECT {k} AS k, * FROM cf{k}" for k in range(1, steps + 1))
    names = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(A.TERMS))
    return f"""{_fractions(source, steps)},
        cf AS MATERIALIZED (SELECT feature, i, b FROM ({coefficients}) WHERE k = (SELECT k FROM settled)),
        rs AS MATERIALIZED (SELECT feature, sum((y - fr - f) ** 2) AS rss, count(*) AS n FROM (
            SELECT sample, feature, any_value(y) AS y, sum(x * b) AS f FROM ll JOIN cf USING (feature, i) GROUP BY 1, 2)
          JOIN fr USING (sample) GROUP BY 1),
        est AS MATERIALIZED (SELECT cf.feature, CASE cf.i {names} END AS term, n, b AS beta, fi.v * rss / (n - 4) AS nu
          FROM cf JOIN fi ON fi.feature = cf.feature AND fi.i = cf.i AND fi.j = cf.i JOIN rs ON rs.feature = cf.feature
          WHERE cf.i > 0 AND fi.v * rss > 0),
        {_mixture()},
        se AS MATERIALIZED (SELECT feature, term, n, beta - d AS lfc, sqrt(nu) + sqrt(vd) AS se FROM est JOIN bias USING (term)),
        s0 AS (SELECT term, quantile_cont(se, 0.05) AS s0 FROM se GROUP BY 1),
        bw AS (SELECT feature, term, lfc, se, lfc / (se + s0) AS w, n - 4 AS dof FROM se JOIN s0 USING (term)),
        bp AS MATERIALIZED (SELECT *, {t_two_sided('w', 'dof')} AS p FROM bw),
        bn AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p, feature) AS rn, count(*) OVER (PARTITION BY term) AS m FROM bp),
        bc AS (SELECT feature, term, lfc, se, w, p, dof, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY term ORDER BY p, feature
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM bn)"""


@query(
    "bias_corrected_glm",
    with_tables("samples", "counts")
    + f""", {_DESIGN}, {_corrected_sql('counts')}
         SELECT feature, term, round(lfc, 5) AS lfc, round(se, 5) AS se, round(w, 4) AS w, round(p, 5) AS p, round(q, 4) AS q,
           CAST(dof AS BIGINT) AS df, q < 0.05 AS diff FROM bc""",
)
def bias_corrected_glm(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    res = A.bias_corrected_glm(counts(spark, d), A.trial_design(s))[0]
    return _r(_r(res, "lfc", "se", "p", places=5), "w", "q", places=4)


@query(
    "log_model_sums",
    with_tables("samples", "counts")
    + f""", {_DESIGN} SELECT feature, count(*) AS n, sum(x1) AS xx0_1, sum(x2) AS xx0_2, sum(x3) AS xx0_3,
           sum(x1 * x2) AS xx1_2, sum(x1 * x3) AS xx1_3, sum(x2 * x3) AS xx2_3,
           {', '.join(f'round(sum(x{i} * ln(reads)), 6) AS xy{i}' for i in range(4))},
           round(sum(ln(reads) ** 2), 6) AS yy FROM counts JOIN design USING (sample) GROUP BY 1""",
)
def log_model_sums(spark: SparkSession, d: str) -> DataFrame:
    sums = A.normal_sums(counts(spark, d), A.trial_design(samples(spark, d)))
    crosses = ("xx0_1", "xx0_2", "xx0_3", "xx1_2", "xx1_3", "xx2_3")
    return _r(sums, "xy0", "xy1", "xy2", "xy3", "yy").select(
        "feature", "n", *crosses, "xy0", "xy1", "xy2", "xy3", "yy"
    )


@query(
    "structural_zeros",
    with_tables("samples", "counts")
    + """, n AS (SELECT challenge AS level, count(*) AS n FROM samples GROUP BY 1),
         p AS (SELECT f.feature, level, n, (SELECT count(*) FROM counts c JOIN samples s USING (sample)
                 WHERE c.feature = f.feature AND s.challenge = n.level) / CAST(n AS DOUBLE) AS p
               FROM (SELECT DISTINCT feature FROM counts) f, n)
         SELECT feature, level, round(p, 6) AS share, p = 0 OR p - 1.96 * sqrt(p * (1 - p) / n) <= 0 AS zero FROM p""",
)
def structural_zeros(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.structural_zeros(counts(spark, d), samples(spark, d), "challenge"), "share")


_PSEUDO = (0.1, 0.25, 0.5, 0.75, 1.0)


@query(
    "pseudo_sensitivity",
    with_tables("samples", "genus")
    + f""", {_DESIGN}, {_BASES}, {_grid('genus')},
         {', '.join(f"c{i} AS (SELECT sample, feature, ln(reads + {v}) AS y FROM grid), {_glm_sql(f'c{i}', f'g{i}')}" for i, v in enumerate(_PSEUDO))},
         a AS ({' UNION ALL '.join(f'SELECT {i} AS k, feature, term, p FROM g{i}' for i in range(len(_PSEUDO)))}),
         f AS (SELECT feature, term, max(CASE WHEN k = 0 THEN CASE WHEN p < 0.05 THEN 1 ELSE 0 END END) AS sig,
                 count(*) FILTER (p < 0.05) AS hits, count(*) AS n FROM a GROUP BY 1, 2)
         SELECT feature, term, sig AS significant,
           round(CASE WHEN sig = 1 THEN n - hits ELSE hits END / CAST(n AS DOUBLE), 6) AS score FROM f""",
)
def pseudo_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _r(A.pseudo_sensitivity(genus_counts(spark, d), A.trial_design(samples(spark, d)), _PSEUDO), "score")


@query(
    "bias_corrected_abundance",
    with_tables("samples", "genus")
    + f""", {_DESIGN}, {_grid('genus')}, {_fractions('genus')}
         SELECT feature AS taxon, name AS community, round(ln(reads + 1) - coalesce(fr, 0), 6) AS bc,
           substr(name, 3, 8) || ' ' || right(name, 1) AS pen, substr(name, 11, 2) AS age, substr(name, 3, 7) AS cohort
         FROM grid JOIN samples USING (sample) LEFT JOIN fr USING (sample)""",
)
def bias_corrected_abundance(spark: SparkSession, d: str) -> DataFrame:
    return _r(_bc_cells(spark, d), "bc")


def _bc_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell less its sample's fitted bias; samples without reads take 0."""
    g, s = genus_counts(spark, d), samples(spark, d)
    return A.bias_corrected_abundance(g, s, A.sampling_fractions(g, A.trial_design(s)))


def _as_cells(bc: DataFrame, design: DataFrame) -> DataFrame:
    """Bias-corrected values under the sample id again, for the association."""
    return bc.join(design.select("sample", F.col("name").alias("community")), "community").select(
        "sample", F.col("taxon").alias("feature"), F.col("bc").alias("x")
    )


@query(
    "term_results",
    with_tables("samples", "genus")
    + f""", {_DESIGN}, {_BASES}, {_grid('genus')}, {_CLR}, {_glm_sql('clr')}
         SELECT feature, term, round(estimate, 6) AS lfc, round(se, 6) AS se, round(p_adj, 6) AS q, p_adj < 0.05 AS diff
         FROM g WHERE term LIKE '%challenge%'""",
)
def term_results(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    res = A.clr_glm(genus_counts(spark, d), s, A.trial_design(s))
    return A.term_slice(res, "challenge").select(
        "feature", "term", F.round("estimate", 6).alias("lfc"), F.round("se", 6).alias("se"),
        F.round("p_adj", 6).alias("q"), (F.col("p_adj") < 0.05).alias("diff"),
    )


@query(
    "daa_concordance",
    with_tables("samples", "genus")
    + f""", {_DESIGN}, {_BASES}, {_grid('genus')}, {_CLR}, {_glm_sql('clr')},
         lg AS (SELECT sample, feature, ln(reads + 1.0) AS y FROM grid), {_glm_sql('lg', 'h')}
         SELECT g.feature, g.term, round(g.p_adj, 6) AS p1, round(h.p_adj, 6) AS p2, round(g.estimate, 6) AS effect,
           round(log10(greatest(g.p_adj, h.p_adj, 1e-300)), 4) AS worst,
           CASE WHEN g.p_adj > 0.05 OR h.p_adj > 0.05 THEN 'p.adj > 0.05' WHEN g.estimate < 0 THEN 'Negative LFC'
             WHEN g.estimate > 0 THEN 'Positive LFC' END AS class
         FROM g JOIN h ON g.feature = h.feature AND g.term = h.term WHERE g.term IN ('challengeSE', 'dietgos')""",
)
def daa_concordance(spark: SparkSession, d: str) -> DataFrame:
    return _concordance(spark, d)


def _concordance(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    design, g = A.trial_design(s), genus_counts(spark, d)
    first = A.clr_glm(g, s, design)
    logs = g.select("sample", "feature", F.log(F.col("reads") + 1.0).alias("y"))
    second = A.adjust_holm(
        A.feature_glm(logs, s.select("sample", F.lit(0.0).alias("y0")), design), ["term"], "p_value"
    )
    both = A.concordance(first, second).where(F.col("term").isin("challengeSE", "dietgos"))
    return _r(both, "p1", "p2", "effect").withColumn("worst", F.round("worst", 4))


@query("method_concordance")
def method_concordance(spark: SparkSession, d: str) -> DataFrame:
    """The bias-corrected model beside the one over Dirichlet instances; the sign class is the former's."""
    s, g = samples(spark, d), genus_counts(spark, d)
    design = A.trial_design(s)
    corrected = A.bias_corrected_glm(g, design)[0].select("feature", "term", F.col("lfc").alias("estimate"), F.col("q").alias("p_adj"))
    over = A.glm_over_instances(A.dirichlet_clr_instances(g, s, instances=128, seed=1216), design)
    return A.concordance(corrected, over).where(F.col("term").isin("challengeSE", "dietgos"))


@query(
    "method_agreement",
    """WITH m AS (SELECT l_partkey AS feature, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b,
              count(*) AS n FROM lineitem GROUP BY 1)
       SELECT feature, CAST(sign(a) AS DOUBLE) AS direction FROM m WHERE abs(a) * sqrt(n) > 1 AND abs(b) * sqrt(n) > 1
         AND sign(a) = sign(b)""",
)
def method_agreement(spark: SparkSession, d: str) -> DataFrame:
    def method(y: str) -> DataFrame:
        rho = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(
            F.corr("l_quantity", y).alias("r"), F.count("*").alias("n")
        )
        return rho.where(F.abs("r") * F.sqrt("n") > 1).select("feature", F.signum("r").alias("direction"))

    return method("l_discount").join(method("l_tax"), ["feature", "direction"])


_ASSOC = f"""dim AS (SELECT a.sample, age AS stratum, analyte, value,
           {midrank('value', 'age, analyte')} AS ry FROM analytes a JOIN samples s ON s.sample = a.sample),
    fe AS (SELECT DISTINCT analyte, stratum, feature FROM dim JOIN xs USING (sample)),
    gr AS (SELECT d.stratum, d.analyte, f.feature, d.ry, coalesce(x.x, 0) AS x FROM dim d
             JOIN fe f ON f.analyte = d.analyte AND f.stratum = d.stratum
             LEFT JOIN xs x ON x.sample = d.sample AND x.feature = f.feature),
    rk AS (SELECT *, {midrank('x', 'stratum, analyte, feature')} AS rx FROM gr),
    co AS (SELECT stratum, analyte, feature, count(*) AS n, corr(rx, ry) AS rho,
             var_pop(rx) * var_pop(ry) AS v FROM rk GROUP BY 1, 2, 3),
    sp AS (SELECT stratum, analyte, feature, n, CASE WHEN v > 0 THEN rho END AS rho,
             CASE WHEN v > 0 AND n > 2 THEN {t_two_sided('rho * sqrt((n - 2) / greatest(1e-12, 1 - rho * rho))', 'greatest(n - 2, 1)')} END AS p
           FROM co)"""


_ASSOC_Q = f"""qn AS (SELECT *, row_number() OVER (PARTITION BY stratum, analyte ORDER BY p, feature) AS rn,
      count(*) OVER (PARTITION BY stratum, analyte) AS m FROM sp WHERE p IS NOT NULL),
    qs AS (SELECT stratum, analyte, feature, {bh('p', 'stratum, analyte', 'feature')} AS q FROM qn)
    SELECT stratum, analyte, feature, n, round(rho, 6) AS estimate, round(p, 6) AS p_value, round(q, 4) AS q
    FROM sp LEFT JOIN qs USING (stratum, analyte, feature)"""


@query(
    "feature_analyte_correlation",
    with_tables("samples", "counts", "analytes")
    + f""", xs AS (SELECT sample, feature, reads AS x FROM counts), {_ASSOC}, {_ASSOC_Q}""",
)
def feature_analyte_correlation(spark: SparkSession, d: str) -> DataFrame:
    cells = counts(spark, d).select("sample", "feature", F.col("reads").alias("x"))
    res = A.feature_analyte_correlation(cells, samples(spark, d), analytes(spark, d), "age")
    return _association(res)


def _association(res: DataFrame) -> DataFrame:
    return _r(res, "estimate", "p_value").withColumn("q", F.round("q", 4))


_BC = f"""{_DESIGN}, {_grid('genus')}, {_fractions('genus')},
    xs AS (SELECT sample, feature, ln(reads + 1) - coalesce(fr, 0) AS x FROM grid LEFT JOIN fr USING (sample))"""


@query("bc_analyte_correlation", with_tables("samples", "genus", "analytes") + f", {_BC}, {_ASSOC}, {_ASSOC_Q}")
def bc_analyte_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The whole route: sampling fractions of the fitted model, corrected values, association with its q."""
    s = samples(spark, d)
    return _association(A.feature_analyte_correlation(_as_cells(_bc_cells(spark, d), s), s, analytes(spark, d), "age"))


@query("corrected_association", with_tables("samples", "genus", "analytes") + f", {_BC}, {_ASSOC}, {_ASSOC_Q}")
def corrected_association(spark: SparkSession, d: str) -> DataFrame:
    """As ``bc_analyte_correlation``, with the fractions that the whole model gives beside its results."""
    s, g = samples(spark, d), genus_counts(spark, d)
    fractions = A.bias_corrected_glm(g, A.trial_design(s))[1]
    bc = A.bias_corrected_abundance(g, s, fractions)
    return _association(A.feature_analyte_correlation(_as_cells(bc, s), s, analytes(spark, d), "age"))


def _with_q(sp: str, name: str) -> str:
    """CTEs up to ``name(stratum, analyte, feature, rho, q)`` from the tests in ``sp``."""
    ranked = _ASSOC_Q.split("qs AS")[0].replace("qn AS", f"{name}n AS").replace("FROM sp ", f"FROM {sp} ").rstrip().rstrip(",")
    return f"""{ranked},
    {name}s AS (SELECT stratum, analyte, feature, {bh('p', 'stratum, analyte', 'feature')} AS q FROM {name}n),
    {name} AS (SELECT stratum, analyte, feature, rho, q FROM {sp} LEFT JOIN {name}s USING (stratum, analyte, feature))"""


@query(
    "correlation_agreement",
    with_tables("samples", "genus", "analytes")
    + f""", {_BC}, {_ASSOC},
         xs2 AS (SELECT sample, feature, CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY sample) AS x FROM genus),
         {_ASSOC.replace('dim AS', 'dim2 AS').replace('FROM dim ', 'FROM dim2 ').replace('fe AS', 'fe2 AS')
             .replace('JOIN fe ', 'JOIN fe2 ').replace('gr AS', 'gr2 AS').replace('FROM gr)', 'FROM gr2)')
             .replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ').replace('co AS', 'co2 AS')
             .replace('FROM co)', 'FROM co2)').replace('sp AS', 'sp2 AS').replace('xs USING', 'xs2 USING')
             .replace('JOIN xs x', 'JOIN xs2 x')},
         {_with_q('sp', 'qa')}, {_with_q('sp2', 'qb')}
         SELECT qa.stratum, qa.analyte, qa.feature, round(qa.q, 4) AS q_bc, round(qb.q, 4) AS q_ra,
           CAST(CASE WHEN round(qa.rho, 9) < 0 THEN 0 ELSE 1 END AS INT) AS sign_bc,
           CAST(CASE WHEN round(qb.rho, 9) < 0 THEN 0 ELSE 1 END AS INT) AS sign_ra,
           coalesce(qa.q <= 0.25 AND qb.q <= 0.25 AND (round(qa.rho, 9) < 0) = (round(qb.rho, 9) < 0), false) AS agrees
         FROM qa JOIN qb ON qa.stratum = qb.stratum AND qa.analyte = qb.analyte AND qa.feature = qb.feature""",
)
def correlation_agreement(spark: SparkSession, d: str) -> DataFrame:
    g, s, an = genus_counts(spark, d), samples(spark, d), analytes(spark, d)
    corrected = A.feature_analyte_correlation(_as_cells(_bc_cells(spark, d), s), s, an, "age")
    share = diversity.relative_abundance(g).select("sample", "feature", F.col("ra").alias("x"))
    by_share = A.feature_analyte_correlation(share, s, an, "age")
    # a level of 0.25, as few associations survive adjustment in the stand-in data
    return _r(A.agreement_table(corrected, by_share, alpha=0.25), "q_bc", "q_ra", places=4)


_KEY = ["Brand#1", "Brand#4", "Brand#7", "Brand#12", "Brand#25"]


@query(
    "control_rank_table",
    with_tables("samples", "genus")
    + f""", {_grid('genus')}, rk AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY reads) AS rk FROM grid),
         k AS (SELECT sample, feature, reads || ' (' || rk || ')' AS cell FROM rk WHERE reads > 0
                 AND sample IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (0, 1, 2)))
         SELECT sample, {', '.join(f'''max(cell) FILTER (feature = '{b}') AS "{b}"''' for b in _KEY)} FROM k
         WHERE feature IN ({', '.join(repr(b) for b in _KEY)}) GROUP BY 1""",
)
def control_rank_table(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    ranked = diversity.rank_across_samples(genus_counts(spark, d), s.count(), "rank")
    controls = table(spark, d, "supplier").where("s_nationkey IN (0, 1, 2)").selectExpr("s_suppkey AS sample")
    return A.control_rank_table(ranked, controls, _KEY)


# terms: intercept, ages 24, 28 and 35, challenge, diet
_LEVELS = {22: None, 24: 1, 28: 2, 35: 3}
_PAIRS = [(x, y) for x in _LEVELS for y in _LEVELS if x < y]


def _contrast_rows() -> str:
    cells = []
    for x, y in _PAIRS:
        cells += [f"('{y} - {x}', {_LEVELS[y]}, 1.0)"] + ([f"('{y} - {x}', {_LEVELS[x]}, -1.0)"] if _LEVELS[x] else [])
    return ", ".join(cells)


@query(
    "group_contrasts",
    with_tables("samples", "counts")
    + f""", {_grid('counts')}, {_CLR},
         dl AS (SELECT sample, unnest(range(0, 6)) AS i, unnest([1.0, CAST(age = 24 AS DOUBLE), CAST(age = 28 AS DOUBLE),
                  CAST(age = 35 AS DOUBLE), CAST(challenge = 'sal' AS DOUBLE), CAST(diet = 'gos' AS DOUBLE)]) AS x FROM samples),
         xx AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM dl a JOIN dl b USING (sample) GROUP BY 1, 2),
         {inverse('iv', 'xx', [0, 1, 2, 3, 4, 5])}, {inverse('gm', 'iv', [1, 2, 3])},
         xy AS MATERIALIZED (SELECT feature, i, sum(x * y) AS v FROM clr JOIN dl USING (sample) GROUP BY 1, 2),
         be AS MATERIALIZED (SELECT feature, iv.i, sum(iv.v * xy.v) AS b FROM xy JOIN iv ON iv.j = xy.i GROUP BY 1, 2),
         np AS (SELECT count(*) AS p, count(*) FILTER (i BETWEEN 1 AND 3) AS g FROM xx WHERE i = j AND v > 0),
         yy AS (SELECT feature, sum(y * y) AS v, count(*) - (SELECT p FROM np) AS dof FROM clr GROUP BY 1),
         s2 AS MATERIALIZED (SELECT be.feature, (any_value(yy.v) - sum(b * xy.v)) / any_value(dof) AS s2, any_value(dof) AS dof
                FROM be JOIN xy ON xy.feature = be.feature AND xy.i = be.i JOIN yy ON yy.feature = be.feature GROUP BY 1),
         gf AS (SELECT a.feature, sum(a.b * gm.v * c.b) / (SELECT g FROM np) / any_value(s2) AS f, any_value(dof) AS dof, (SELECT g FROM np) AS d1
                FROM be a JOIN gm ON gm.i = a.i JOIN be c ON c.feature = a.feature AND c.i = gm.j JOIN s2 ON s2.feature = a.feature GROUP BY 1),
         gp AS (SELECT feature, {f_sf('f', 'd1', 'dof')} AS p FROM gf),
         gr AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rn, count(*) OVER () AS m FROM gp),
         gq AS MATERIALIZED (SELECT feature, p, m, least(1.0, min(p * m / rn) OVER (ORDER BY p DESC, feature DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM gr),
         cw AS (SELECT contrast, i, w FROM (VALUES {_contrast_rows()}) t(contrast, i, w)
                WHERE CAST(split_part(contrast, ' - ', 1) AS INT) IN (SELECT age FROM samples)
                  AND CAST(split_part(contrast, ' - ', 2) AS INT) IN (SELECT age FROM samples)),
         cv AS (SELECT a.contrast, sum(a.w * b.w * iv.v) AS v FROM cw a JOIN cw b USING (contrast) JOIN iv ON iv.i = a.i AND iv.j = b.i GROUP BY 1),
         ce AS (SELECT feature, contrast, sum(w * b) AS d FROM be JOIN cw USING (i) GROUP BY 1, 2),
         ct AS (SELECT feature, contrast, d, sqrt(s2 * cv.v) AS se, dof FROM ce JOIN cv USING (contrast) JOIN s2 USING (feature)),
         p AS (SELECT *, {t_two_sided('d / se', 'dof')} AS p FROM ct),
         n AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY p, contrast) AS rn,
                 count(*) OVER (PARTITION BY feature) AS m FROM p),
         h AS (SELECT feature, contrast, d, se, p, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY feature ORDER BY p, contrast
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM n)
         SELECT feature, contrast, round(d, 6) AS estimate, round(se, 6) AS se, round(d / se, 5) AS statistic,
           round(h.p, 6) AS p_value, round(p_adj, 6) AS p_adj, round(gq.p, 5) AS global_p, round(q, 4) AS global_q,
           CAST(CASE WHEN q <= 0.2 AND p_adj <= 0.2 * (SELECT count(*) FILTER (q <= 0.2) / CAST(count(*) AS DOUBLE) FROM gq)
             THEN sign(d) ELSE 0 END AS INT) AS direction
         FROM h JOIN gq USING (feature)""",
)
def group_contrasts(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    # the stand-in counts hold no effect; a level of 0.2 lets some of them pass the first test
    res = A.group_contrasts(counts(spark, d), s, "age", ["challenge", "diet"], alpha=0.2)
    return _r(res, "estimate", "se", "p_value", "p_adj").withColumns(
        {"statistic": F.round("statistic", 5), "global_p": F.round("global_p", 5), "global_q": F.round("global_q", 4)}
    )


@query(
    "taxon_agglomerate",
    with_tables("counts")
    + """ SELECT sample, p_brand AS label, CAST(sum(reads) AS BIGINT) AS reads
          FROM counts JOIN part ON p_partkey = feature GROUP BY 1, 2""",
)
def taxon_agglomerate(spark: SparkSession, d: str) -> DataFrame:
    return A.agglomerate(counts(spark, d), taxonomy(spark, d), rank=2)
