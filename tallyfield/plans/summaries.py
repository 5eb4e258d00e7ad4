"""Grouped summaries, windows and reporting tables as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import adjust, diversity, ranks, reports, seqs, stats
from ..proxies import counts, lines, samples, table
from .registry import query, with_tables
from .sqltext import bh, midrank

# ---------------------------------------------------------------- aggregations


@query(
    "count_by_group",
    with_tables("samples") + " SELECT diet, challenge, age, count(*) AS n FROM samples GROUP BY ALL",
)
def count_by_group(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("diet", "challenge", "age").agg(F.count("*").alias("n"))


@query(
    "mean_by_unit",
    """SELECT l_suppkey, l_returnflag, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def mean_by_unit(spark: SparkSession, d: str) -> DataFrame:
    return reports.mean_by_unit(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_discount").withColumn(
        "mean", F.round("mean", 6)
    )


@query(
    "distinct_count",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS samples, count(DISTINCT l_partkey) AS features
       FROM lineitem GROUP BY 1""",
)
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("samples"), F.countDistinct("l_partkey").alias("features")
    )


@query("distinct_values", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query(
    "conditional_count",
    """SELECT source, count(*) AS n, CAST(sum(len(regexp_extract_all(text, 'and'))) AS BIGINT) AS hits,
         count(*) FILTER (text LIKE '%|%') AS with_bar FROM documents GROUP BY 1""",
)
def conditional_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("and"))).alias("hits"),
        F.count_if(F.col("text").contains("|")).alias("with_bar"),
    )


def _signif3(x: str) -> str:
    e = f"floor(log10(nullif({x}, 0)))"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0 WHEN {e} >= 2 THEN round_even({x} / pow(10, {e} - 2), 0) * pow(10, {e} - 2) "
        f"ELSE round_even({x} * pow(10, 2 - {e}), 0) / pow(10, 2 - {e}) END"
    )


def _cell(k: str) -> str:
    return (
        f"{k} || ' (' || regexp_replace(CAST({_signif3(f'(100 * ({k} / (neg + pos)))')} AS VARCHAR), '\\.0$', '') "
        f"|| '%)'"
    )


@query(
    "count_percent_table",
    f"""WITH t AS (SELECT o_orderstatus AS age, o_orderpriority AS "group",
                     CAST(count(*) FILTER (o_totalprice < 200000) AS BIGINT) AS neg,
                     CAST(count(*) FILTER (o_totalprice >= 200000) AS BIGINT) AS pos FROM orders GROUP BY 1, 2)
        SELECT age, "group", {_cell('neg')} AS neg, {_cell('pos')} AS pos FROM t""",
)
def count_percent_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("age"), F.col("o_orderpriority").alias("group"),
        F.when(F.col("o_totalprice") < 200000, "neg").otherwise("pos").alias("status"),
    )
    return reports.count_percent_table(rows, ["age", "group"], "status", ["neg", "pos"])


@query(
    "total_rollup",
    with_tables("counts")
    + """ SELECT sample, feature, reads FROM counts
          UNION ALL SELECT sample, NULL, CAST(sum(reads) AS BIGINT) FROM counts GROUP BY 1""",
)
def total_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_totals(counts(spark, d))


@query(
    "median_hilow",
    """SELECT o_orderstatus, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
         round(quantile_cont(o_totalprice, 0.025), 4) AS low, round(quantile_cont(o_totalprice, 0.975), 4) AS high
       FROM orders GROUP BY 1""",
)
def median_hilow(spark: SparkSession, d: str) -> DataFrame:
    q = ranks.quantiles(
        table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", {"median": 0.5, "low": 0.025, "high": 0.975}
    )
    return q.withColumns({c: F.round(c, 4) for c in ("median", "low", "high")})


@query(
    "boxplot_summary",
    """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.5) AS mi,
                    quantile_cont(value, 0.75) AS hi FROM events GROUP BY 1),
            r AS (SELECT e.event_type, value, n, lo, mi, hi,
                    value BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) AS inside
                  FROM events e JOIN q ON e.event_type = q.event_type)
       SELECT event_type, n, round(lo, 6) AS lower, round(mi, 6) AS middle, round(hi, 6) AS upper,
         min(value) FILTER (inside) AS ymin, max(value) FILTER (inside) AS ymax,
         count(*) FILTER (NOT inside) AS n_outliers FROM r GROUP BY event_type, n, lo, mi, hi""",
)
def boxplot_summary(spark: SparkSession, d: str) -> DataFrame:
    box = stats.boxplot_summary(table(spark, d, "events"), ["event_type"], "value")
    return box.withColumns({c: F.round(c, 6) for c in ("lower", "middle", "upper")})


@query(
    "collect_group_list",
    """SELECT o_custkey, list(o_totalprice ORDER BY o_totalprice) AS prices FROM orders GROUP BY 1""",
)
def collect_group_list(spark: SparkSession, d: str) -> DataFrame:
    # an experimental unit's replicates: bounded by the design, hence safe to hold in one row
    return reports.list_by_group(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "prices")


@query(
    "complete_strata_filter",
    with_tables("samples")
    + """, n AS (SELECT s_nationkey AS gene, age, count(*) FILTER (diet = 'ctl') AS n_ctl,
                   count(*) FILTER (diet = 'gos') AS n_gos
                 FROM samples JOIN supplier ON s_suppkey = sample GROUP BY 1, 2),
            same AS (SELECT gene FROM n GROUP BY gene, n_ctl, n_gos HAVING count(*) >= 2)
          SELECT gene, age, n_ctl, n_gos FROM n WHERE gene IN (SELECT gene FROM same)""",
)
def complete_strata_filter(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("gene"))
    n = samples(spark, d).join(nation, "sample").groupBy("gene", "age").agg(
        F.count_if(F.col("diet") == "ctl").alias("n_ctl"), F.count_if(F.col("diet") == "gos").alias("n_gos")
    )
    # two of the four ages, as the stand-in design is not complete
    return reports.keep_complete(n, "gene", ["n_ctl", "n_gos"], strata=2)


@query(
    "extreme_of_groups",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT o_orderstatus, min(n) AS least, max(n) AS most FROM g GROUP BY 1""",
)
def extreme_of_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.groupBy("o_orderstatus").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query(
    "string_aggregate",
    """SELECT p_type, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS brands FROM part GROUP BY 1""",
)
def string_aggregate(spark: SparkSession, d: str) -> DataFrame:
    distinct = table(spark, d, "part").select("p_type", "p_brand").distinct()
    return reports.join_text(distinct, ["p_type"], "p_brand", "; ", "brands")


@query(
    "baseline_fold_change",
    """WITH b AS (SELECT l_suppkey, avg(l_quantity) AS base FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l_suppkey, round(l_quantity / base, 6) AS fold_change
       FROM lineitem LEFT JOIN b USING (l_suppkey)""",
)
def baseline_fold_change(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    fc = stats.baseline_fold_change(rows, ["l_suppkey"], "l_quantity", "l_returnflag", "N")
    return fc.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("fold_change", 6).alias("fold_change"))


_FEATURES = ("length", "ambig", "homopolymer", "first_base", "last_base")


@query(
    "sequence_summary",
    with_tables("lines")
    + """, u AS (SELECT row_number() OVER () AS r, seq, count(*) AS freq FROM lines GROUP BY seq),
         ch AS (SELECT r, unnest(range(0, len(string_split(seq, '')))) AS i, unnest(string_split(seq, '')) AS c FROM u),
         runs AS (SELECT r, c, i - row_number() OVER (PARTITION BY r, c ORDER BY i) AS g FROM ch),
         hp AS (SELECT r, max(k) AS homopolymer FROM (SELECT r, count(*) AS k FROM runs GROUP BY r, c, g) GROUP BY 1),
         f AS (SELECT freq, homopolymer, length(seq) AS length, len(regexp_extract_all(seq, '[^A-Za-z]')) AS ambig,
                 CASE WHEN regexp_matches(seq, '[^ .]') THEN length(regexp_extract(seq, '^[ .]*')) + 1 ELSE 0 END
                   AS first_base,
                 length(regexp_replace(seq, '[ .]+$', '')) AS last_base FROM u JOIN hp USING (r)),
         l AS (SELECT 'length' AS feature, length AS v, freq FROM f UNION ALL SELECT 'ambig', ambig, freq FROM f
               UNION ALL SELECT 'homopolymer', homopolymer, freq FROM f
               UNION ALL SELECT 'first_base', first_base, freq FROM f
               UNION ALL SELECT 'last_base', last_base, freq FROM f),
         x AS (SELECT feature, CAST(v AS DOUBLE) AS v FROM l, range(0, freq) r)
         SELECT feature, count(*) AS n, min(v) AS minimum, quantile_cont(v, 0.025) AS q025,
           quantile_cont(v, 0.25) AS q250, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q750,
           quantile_cont(v, 0.975) AS q975, max(v) AS maximum, round(avg(v), 6) AS mean FROM x GROUP BY 1""",
)
def sequence_summary(spark: SparkSession, d: str) -> DataFrame:
    unique = lines(spark, d).groupBy("seq").agg(F.count("*").alias("freq"))
    feats = seqs.sequence_features(unique, "seq", alphabet="A-Za-z", gaps=" .").select("freq", *_FEATURES)
    return seqs.feature_summary(feats, _FEATURES, "freq").withColumn("mean", F.round("mean", 6))


@query(
    "weighted_error_rate",
    """SELECT l_returnflag, round(sum(CAST(l_linenumber * l_quantity AS BIGINT))
         / (CAST(sum(l_quantity) AS BIGINT) * 250), 6) AS rate FROM lineitem GROUP BY 1""",
)
def weighted_error_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_linenumber").alias("errors"), F.col("l_quantity").cast("long").alias("sequences")
    )
    return seqs.weighted_error_rate(rows, "errors", "sequences", by=["l_returnflag"]).withColumn(
        "rate", F.round("rate", 6)
    )


@query(
    "dereplicate",
    """WITH u AS (SELECT text, min(doc_id) AS rep FROM documents GROUP BY 1)
       SELECT rep, source AS sample, count(*) AS n FROM documents JOIN u USING (text) GROUP BY 1, 2""",
)
def dereplicate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("seq_id"), F.col("source").alias("sample"), F.col("text").alias("seq")
    )
    return seqs.dereplicate(docs)[1]


@query(
    "feature_table",
    with_tables("lines")
    + """, u AS (SELECT seq, sample, count(*) AS n FROM lines GROUP BY 1, 2)
          SELECT sample, length(seq) % 10 AS otu, CAST(sum(n) AS BIGINT) AS reads FROM u GROUP BY 1, 2""",
)
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    per = lines(spark, d).groupBy("seq", "sample").agg(F.count("*").alias("n"))
    clusters = per.select("seq").distinct().select("seq", (F.length("seq") % 10).cast("long").alias("otu"))
    return seqs.feature_table(per, clusters, "seq")


@query(
    "confidence_ellipse",
    """WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mx, avg(l_discount * 1000) AS my,
            var_samp(l_quantity) AS sxx, var_samp(l_discount * 1000) AS syy,
            covar_samp(l_quantity, l_discount * 1000) AS sxy FROM lineitem GROUP BY 1, 2),
         e AS (SELECT *, (sxx + syy) / 2 AS h, sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2) AS r FROM a)
       SELECT l_returnflag, l_linestatus, n, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(h + r, 4) AS l1,
         round(h - r, 4) AS l2, round(atan2(h + r - sxx, sxy), 4) AS angle,
         round(sqrt((h + r) * (n - 1) * (pow(0.05, -2.0 / (n - 1)) - 1) / n), 4) AS semi_major FROM e""",
)
def confidence_ellipse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("y", F.col("l_discount") * 1000)
    e = stats.confidence_ellipse(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "y")
    return e.select(
        "l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y")],
        *[F.round(c, 4).alias(c) for c in ("l1", "l2", "angle", "semi_major")],
    )


@query(
    "error_bounds",
    """SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - stddev_samp(value) / sqrt(count(*)), 6)
         AS ymin, round(avg(value) + stddev_samp(value) / sqrt(count(*)), 6) AS ymax FROM events GROUP BY 1""",
)
def error_bounds(spark: SparkSession, d: str) -> DataFrame:
    return reports.mean_sem(table(spark, d, "events"), ["event_type"], "value").select(
        "event_type", *[F.round(c, 6).alias(c) for c in ("mean", "ymin", "ymax")]
    )


@query(
    "count_if_many",
    """SELECT l_suppkey, count(*) FILTER (l_discount <= 0.05) AS low_discount,
         count(*) FILTER (l_quantity > 25 AND l_tax > 0.04) AS big_taxed,
         count(*) FILTER (l_returnflag = 'A') AS returned FROM lineitem GROUP BY 1""",
)
def count_if_many(spark: SparkSession, d: str) -> DataFrame:
    return reports.count_where(
        table(spark, d, "lineitem"), ["l_suppkey"],
        {"low_discount": "l_discount <= 0.05", "big_taxed": "l_quantity > 25 AND l_tax > 0.04",
         "returned": "l_returnflag = 'A'"},
    )


# ---------------------------------------------------------------- windows


@query(
    "rank_ties_max",
    with_tables("counts", "samples")
    + """, g AS (SELECT f.feature, s.sample, coalesce(c.reads, 0) AS reads FROM (SELECT DISTINCT feature FROM counts) f
                 CROSS JOIN samples s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample)
          SELECT sample, feature, reads, rnk FROM (
            SELECT *, count(*) OVER (PARTITION BY feature ORDER BY reads) AS rnk FROM g) WHERE reads > 0""",
)
def rank_ties_max(spark: SparkSession, d: str) -> DataFrame:
    return diversity.rank_across_samples(counts(spark, d), samples(spark, d).count(), "rnk")


@query(
    "rank_average",
    f"""SELECT o_orderkey, o_orderstatus, {midrank('v', 'o_orderstatus')} AS rnk
        FROM (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice / 100) AS BIGINT) AS v FROM orders)""",
)
def rank_average(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 100).alias("v")
    )
    return ranks.with_rank(rows, ["o_orderstatus"], "v", "midrank", "rnk").drop("v")


@query(
    "relative_abundance",
    with_tables("counts")
    + """ SELECT sample, feature, round(100.0 * reads / sum(reads) OVER (PARTITION BY sample), 6) AS ra FROM counts""",
)
def relative_abundance(spark: SparkSession, d: str) -> DataFrame:
    return diversity.relative_abundance(counts(spark, d)).select("sample", "feature", F.round("ra", 6).alias("ra"))


# a result table with one p-value per order: strata of thousands of rows, ties and NULLs
_P = """SELECT o_orderkey AS id, o_orderstatus AS stratum,
          CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE least(1.0, round(o_totalprice / 450000, 3)) END AS p FROM orders"""


def _p_table(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 450000, 3))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stratum"),
        F.when(F.col("o_custkey") % 11 != 0, p).alias("p"),
    )


@query(
    "adjust_bh",
    f"""WITH r AS ({_P}), n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, id) AS rn,
             count(*) OVER (PARTITION BY stratum) AS m FROM r WHERE p IS NOT NULL),
           a AS (SELECT id, {bh('p', 'stratum', 'id')} AS p_adj FROM n)
        SELECT r.id, r.stratum, r.p, round(p_adj, 6) AS p_adj FROM r LEFT JOIN a USING (id)""",
)
def adjust_bh(spark: SparkSession, d: str) -> DataFrame:
    return adjust.adjust_bh(_p_table(spark, d), ["stratum"], "p", materialize=False).withColumn(
        "p_adj", F.round("p_adj", 6)
    )


@query(
    "adjust_holm",
    f"""WITH r AS ({_P.replace('450000', '450000000').replace(', 3)', ', 6)')}),
           n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, id) AS rn,
             count(*) OVER (PARTITION BY stratum) AS m FROM r WHERE p IS NOT NULL),
           a AS (SELECT id, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY stratum ORDER BY p, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM n)
        SELECT r.id, r.stratum, r.p, round(p_adj, 6) AS p_adj FROM r LEFT JOIN a USING (id)""",
)
def adjust_holm(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 450000000, 6))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stratum"),
        F.when(F.col("o_custkey") % 11 != 0, p).alias("p"),
    )
    return adjust.adjust_holm(rows, ["stratum"], "p", materialize=False).withColumn("p_adj", F.round("p_adj", 6))


@query(
    "group_mutate",
    """SELECT o_custkey, o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6)
         AS centred, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""",
)
def group_mutate(spark: SparkSession, d: str) -> DataFrame:
    return reports.centre_in_group(
        table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice"
    ).select("o_custkey", "o_orderkey", F.round("centred", 6).alias("centred"), "n")


@query(
    "top_effects",
    """SELECT p_partkey, p_retailprice - 1000 AS lfc,
         CASE WHEN p_retailprice > 1000 THEN 'Positive LFC' ELSE 'Negative LFC' END AS direct
       FROM part WHERE p_size <= 5 ORDER BY lfc DESC, p_partkey""",
)
def top_effects(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import tidy

    res = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("lfc"), "p_size")
    return tidy.effects_listing(res, "lfc", F.col("p_size") <= 5, ["p_partkey"]).select(
        "p_partkey", "lfc", "direct"
    )
