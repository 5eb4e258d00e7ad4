"""Scans, projections, filters, joins, reshaping and scalar functions as named queries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import scalars as S
from ..operators import tidy
from ..proxies import counts, lines, samples, table, taxonomy
from ..session import scratch_path
from ..sources import tables as src
from .registry import query, with_tables

# ---------------------------------------------------------------- scans and sinks


@query(
    "scan_tsv",
    "SELECT o_orderkey AS unit, o_orderstatus AS stratum, o_totalprice AS value FROM orders",
)
def scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    src.write_tsv(
        table(spark, d, "orders").selectExpr("o_orderkey unit", "o_orderstatus stratum", "o_totalprice value"), path
    )
    return src.read_tsv(spark, path, "unit long, stratum string, value double")


@query(
    "scan_csv",
    """SELECT c_custkey AS bird_id, c_mktsegment AS "Diet", c_acctbal AS "Salmonella (log10 CFU)" FROM customer""",
)
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey bird_id", "c_mktsegment Diet", "c_acctbal `Salmonella (log10 CFU)`"
    )
    # a byte-order mark before the first header name, as spreadsheet exports have it
    rows.withColumnRenamed("bird_id", "\ufeffbird_id").write.option("header", True).csv(path)
    return src.read_csv(spark, path, "bird_id long, Diet string, `Salmonella (log10 CFU)` double")


@query(
    "scan_name_repair",
    """SELECT c_custkey AS "Sample.ID", c_acctbal AS "abs..mM.", c_nationkey AS "X2nd.pen" FROM customer""",
)
def scan_name_repair(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "names")
    table(spark, d, "customer").selectExpr(
        "c_custkey `Sample ID`", "c_acctbal `abs (mM)`", "c_nationkey `2nd pen`"
    ).write.option("header", True).csv(path)
    return src.repair_names(src.read_csv(spark, path, "`Sample ID` long, `abs (mM)` double, `2nd pen` int"))


@query(
    "scan_ranged_sheet",
    "SELECT 'c' || c_custkey AS sample_id, c_acctbal AS acetic, c_acctbal * 2 AS lactic FROM customer",
)
def scan_ranged_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    n = rows.count()
    body = rows.selectExpr(
        "c_custkey + 4 AS row_no", "concat('note', c_custkey) z", "concat('c', c_custkey) a", "cast(c_acctbal AS string) b",
        "cast(c_acctbal * 2 AS string) c", "'beyond' d",
    )
    head = spark.createDataFrame(
        [(1, "late trial", None, None, None, None), (2, "Note", "Sample ID", "Acetic", "Lactic", ""),
         (3, None, None, "ppm", "ppm", None), (n + 4, "footer", "x", "x", "x", "x")],
        "row_no long, z string, a string, b string, c string, d string",
    )
    # the sheet has no line numbers of its own; its rows are in order over the files
    path = scratch_path(spark, "sheet")
    sheet = body.unionByName(head).repartitionByRange("row_no").sortWithinPartitions("row_no")
    sheet.drop("row_no").write.option("sep", "\t").csv(path)
    found = src.read_ranged_sheet(spark, path, header_row=2, last_row=n + 3, first_col=2, last_col=4)
    return found.select(
        F.col("Sample ID").alias("sample_id"), S.as_numeric(F.col("Acetic")).alias("acetic"),
        S.as_numeric(F.col("Lactic")).alias("lactic"),
    )


@query(
    "scan_manifest",
    with_tables("samples")
    + """ SELECT name AS "group", age || '-' || sample || '_R1.fastq.gz' AS r1,
          age || '-' || sample || '_R2.fastq.gz' AS r2 FROM samples""",
)
def scan_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    samples(spark, d).select(
        "name", *[F.format_string("%s-%s_R%s.fastq.gz", "age", "sample", F.lit(r)).alias(f"r{r}") for r in (1, 2)]
    ).write.option("sep", "\t").csv(path)
    return src.read_manifest(spark, path)


@query(
    "scan_fasta",
    with_tables("lines")
    + """ SELECT doc_id || '_' || pos AS seq_id, seq,
                 CAST(length(seq) AS INT) AS length FROM lines""",
)
def scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    wrapped = F.regexp_replace("seq", "(?s)(.{60})", "$1\n")
    header = F.format_string("%s_%s A>G variant", "doc_id", "pos")
    src.write_fasta(lines(spark, d).select(header.alias("seq_id"), wrapped.alias("seq")), path)
    return src.read_fasta(spark, path)


@query(
    "scan_fastq",
    with_tables("lines")
    + """, reads AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 4 THEN '' ELSE seq END AS seq FROM lines)
         SELECT 'r' || doc_id || '_' || pos AS seq_id, seq,
          CASE WHEN seq = '' THEN '' WHEN pos % 3 = 0 THEN repeat('@', length(seq))
            WHEN pos % 3 = 1 THEN '@' || repeat('+', length(seq) - 1)
            ELSE repeat('I', length(seq)) END AS qual FROM reads""",
)
def scan_fastq(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "fastq")
    name = F.format_string("@r%s_%s", "doc_id", "pos")
    qual = F.expr(
        "CASE WHEN seq = '' THEN '' WHEN pos % 3 = 0 THEN repeat('@', length(seq)) "
        "WHEN pos % 3 = 1 THEN '@' || repeat('+', length(seq) - 1) ELSE repeat('I', length(seq)) END"
    )
    reads = lines(spark, d).withColumn("seq", F.when(F.col("pos") % 5 == 4, "").otherwise(F.col("seq")))  # some are empty
    reads.select(F.concat_ws("\n", name, "seq", F.lit("+"), qual).alias("value")).write.text(path)
    return src.read_fastq(spark, path)


@query("sink_tsv", "SELECT p_partkey AS feature, p_name AS taxon, p_retailprice AS lfc FROM part")
def sink_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sink")
    src.write_tsv(table(spark, d, "part").selectExpr("p_partkey feature", "p_name taxon", "p_retailprice lfc"), path)
    return spark.read.option("sep", "\t").option("header", True).schema("feature long, taxon string, lfc double").csv(
        path
    )


@query(
    "literal_frame",
    with_tables("samples")
    + """ SELECT diet, age, challenge, reads FROM (
            SELECT s.diet, s.age, 'sal' AS challenge, CAST(count(*) AS BIGINT) AS reads FROM samples s
            WHERE challenge = 'sal' GROUP BY ALL
            UNION ALL
            SELECT d.diet, a.age, 'Mock', NULL FROM (VALUES ('GOS'), ('ctl')) d(diet),
              (SELECT DISTINCT age FROM samples) a)""",
)
def literal_frame(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    seen = s.where("challenge = 'sal'").groupBy("diet", "age", "challenge").agg(F.count("*").alias("reads"))
    blank = s.select("age").distinct().select(
        F.explode(F.array(F.lit("GOS"), F.lit("ctl"))).alias("diet"), "age", F.lit("Mock").alias("challenge")
    )
    return seen.unionByName(blank, allowMissingColumns=True)


@query(
    "scan_multi_file",
    """SELECT o_orderkey AS unit, o_totalprice AS value, 'status_' || o_orderstatus AS origin FROM orders""",
)
def scan_multi_file(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_path(spark, "many")
    orders = table(spark, d, "orders")
    paths = []
    for status in ("F", "O", "P"):  # fixed status codes
        paths.append(f"{base}/status_{status}")
        src.write_tsv(
            orders.where(F.col("o_orderstatus") == status).selectExpr("o_orderkey unit", "o_totalprice value"),
            paths[-1],
        )
    return src.read_many(spark, paths, "unit long, value double")


# ---------------------------------------------------------------- projections and filters


@query("project_columns", "SELECT l_suppkey, l_partkey, l_quantity FROM lineitem")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")


@query(
    "project_by_pattern",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders",
)
def project_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    return df.select(*tidy.columns_matching(df, starts_with="o_order"))


@query("project_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def project_by_type(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    return df.select(*tidy.columns_of_type(df, NumericType))


@query(
    "feature_prevalence_filter",
    with_tables("counts")
    + """, kept AS (SELECT feature FROM counts GROUP BY feature HAVING max(reads) >= 50
              AND count(*) FILTER (reads > 0) >= 0.1 * (SELECT count(*) FROM supplier))
          SELECT sample, feature, reads FROM counts WHERE feature IN (SELECT feature FROM kept)""",
)
def feature_prevalence_filter(spark: SparkSession, d: str) -> DataFrame:
    return tidy.depth_prevalence_filter(counts(spark, d), samples(spark, d))


@query(
    "rename_columns",
    "SELECT l_suppkey AS sample, l_partkey AS feature, l_quantity AS quantity, l_discount AS discount FROM lineitem",
)
def rename_columns(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount")
    named = df.withColumnsRenamed({"l_suppkey": "sample", "l_partkey": "feature"})
    return tidy.rename_by_pattern(named, r"^l_", "")


@query("reorder_columns", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def reorder_columns(spark: SparkSession, d: str) -> DataFrame:
    return tidy.relocate(table(spark, d, "customer"), ["c_mktsegment"])


@query(
    "filter_compound",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_returnflag <> 'N' AND l_quantity BETWEEN 10 AND 20 AND (l_linestatus = 'F' OR l_discount >= 0.05)""",
)
def filter_compound(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .where(
            (F.col("l_returnflag") != "N")
            & F.col("l_quantity").between(10, 20)
            & ((F.col("l_linestatus") == "F") | (F.col("l_discount") >= 0.05))
        )
        .select("l_orderkey", "l_linenumber", "l_quantity")
    )


@query(
    "slice_rows",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn >= 2""",
)
def slice_rows(spark: SparkSession, d: str) -> DataFrame:
    return tidy.slice_from_second(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


@query(
    "drop_nulls",
    """SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
       WHERE quality IS NOT NULL""",
)
def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").na.drop(
        subset=["quality"]
    )


@query(
    "filter_membership",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R')
       AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
)
def filter_membership(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_returnflag").isin("A", "R"))
        .join(keys, "l_suppkey", "left_semi")
        .select("l_orderkey", "l_linenumber", "l_suppkey")
    )


@query(
    "filter_regex",
    with_tables("samples")
    + r""" SELECT name FROM samples WHERE regexp_matches(name, '^l_[a-z]{3}_[a-z]{3}_\d{2}_\d')""",
)
def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where(F.col("name").rlike(r"^l_[a-z]{3}_[a-z]{3}_\d{2}_\d")).select("name")


@query(
    "case_labels",
    with_tables("samples")
    + """ SELECT name, CASE WHEN diet = 'ctl' THEN 'ctl' WHEN age < 28 THEN '+GOS' ELSE 'ctl' END AS feed,
            CASE WHEN challenge = 'sal' THEN 'SE' WHEN challenge = 'unc' THEN 'mock' ELSE 'fail' END AS challenge,
            CASE diet || ' ' || challenge WHEN 'ctl unc' THEN 'ctl x Mock' WHEN 'gos unc' THEN 'jGOS x Mock'
              WHEN 'ctl sal' THEN 'ctl x SE' WHEN 'gos sal' THEN 'jGOS x SE' END AS cohort FROM samples""",
)
def case_labels(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select(
        "name",
        S.feed_label(F.col("diet"), F.col("age")).alias("feed"),
        S.challenge_label(F.col("challenge")).alias("challenge"),
        S.cohort_label(F.col("diet"), F.col("challenge")).alias("cohort"),
    )


@query(
    "recode_values",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 'Significant' ELSE 'Nonsignificant' END
       AS call FROM lineitem""",
)
def recode_values(spark: SparkSession, d: str) -> DataFrame:
    flag = (F.col("l_discount") >= 0.05).cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", tidy.recode(flag, {1: "Significant", 0: "Nonsignificant"}).alias("call")
    )


@query(
    "fill_nulls",
    """SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").na.fill(0, ["quality", "toxic"])


@query(
    "across_columns",
    """SELECT l_orderkey, l_linenumber, 100 * l_discount AS l_discount, 100 * l_tax AS l_tax FROM lineitem""",
)
def across_columns(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return tidy.across(df, ["l_discount", "l_tax"], lambda c: 100 * c)


@query(
    "unit_conversion",
    """WITH w(analyte, mol_wt, factor) AS (VALUES ('click', 60.05, 1.0), ('view', 74.08, 1.0),
         ('purchase', 88.11, 0.001), ('signup', 178.23, 1.0), ('error', 102.13, 1.0))
       SELECT event_id, event_type AS analyte, round((value * factor / 1000) / mol_wt * 1000, 6) AS mM
       FROM events JOIN w ON event_type = analyte""",
)
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    # weights of five acids assigned to the five analytes at hand; the third is reported in ppb
    weights = tidy.analyte_constants(
        spark,
        {"click": "Acetic acid", "view": "Propionate", "purchase": "Isobutyric acid", "signup": "Butyrate",
         "error": "Valerate"},
    )
    values = table(spark, d, "events").select("event_id", F.col("event_type").alias("analyte"), "value")
    return tidy.to_millimolar(values, weights).select("event_id", "analyte", F.round("mM", 6).alias("mM"))


@query(
    "sample_filter",
    with_tables("counts")
    + """, kept AS (SELECT * FROM counts WHERE sample NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5))
          SELECT sample, feature, reads FROM kept
          WHERE feature IN (SELECT feature FROM kept GROUP BY feature HAVING sum(reads) > 0)""",
)
def sample_filter(spark: SparkSession, d: str) -> DataFrame:
    drop = table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("sample"))
    return tidy.drop_samples(counts(spark, d), drop)


@query(
    "lineage_filter",
    with_tables("counts", "taxonomy")
    + """ SELECT sample, feature, reads FROM counts WHERE feature IN (
            SELECT feature FROM taxonomy WHERE split_part(split_part(taxonomy, ';', 1), '(', 1) <> 'ECONOMY'
              AND split_part(split_part(taxonomy, ';', 2), '(', 1) NOT IN ('Brand#3', 'Brand#7'))""",
)
def lineage_filter(spark: SparkSession, d: str) -> DataFrame:
    return tidy.lineage_filter(
        counts(spark, d), taxonomy(spark, d), exclude=["ECONOMY", "Brand#3", "Brand#7"]
    )


@query(
    "library_size_filter",
    with_tables("counts")
    + """ SELECT sample, feature, reads FROM counts WHERE sample IN (
            SELECT sample FROM counts GROUP BY sample HAVING sum(reads) >= 15000)""",
)
def library_size_filter(spark: SparkSession, d: str) -> DataFrame:
    return tidy.library_size_filter(counts(spark, d), 15000)


@query(
    "keyed_lookup",
    """WITH res AS (SELECT o_orderstatus AS stratum, o_orderpriority AS cohort,
           round(avg(o_totalprice), 4) AS estimate FROM orders GROUP BY 1, 2)
       SELECT stratum, cohort, estimate FROM res WHERE (stratum, cohort) IN (('F', '1-URGENT'), ('O', '5-LOW'))""",
)
def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("stratum"), F.col("o_orderpriority").alias("cohort")
    ).agg(F.round(F.avg("o_totalprice"), 4).alias("estimate"))
    keys = spark.createDataFrame([("F", "1-URGENT"), ("O", "5-LOW")], "stratum string, cohort string")
    return tidy.lookup(res, keys)


# ---------------------------------------------------------------- joins


@query(
    "join_left_named_keys",
    """SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment FROM orders o
       LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def join_left_named_keys(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_custkey", "c_mktsegment")


@query(
    "join_natural_left",
    with_tables("counts", "taxonomy")
    + " SELECT sample, feature, reads, taxonomy FROM counts LEFT JOIN taxonomy USING (feature)",
)
def join_natural_left(spark: SparkSession, d: str) -> DataFrame:
    return tidy.natural_left_join(counts(spark, d), taxonomy(spark, d))


@query(
    "join_suffixes",
    """WITH a AS (SELECT l_suppkey AS k, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS estimate
                  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
            b AS (SELECT l_suppkey AS k, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS estimate
                  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
       SELECT a.k AS k_bc, a.f AS f_bc, a.estimate AS estimate_bc, b.k AS k_ra, b.f AS f_ra, b.estimate AS estimate_ra
       FROM a LEFT JOIN b ON a.k = b.k AND a.f = b.f""",
)
def join_suffixes(spark: SparkSession, d: str) -> DataFrame:
    def side(status: str) -> DataFrame:
        return (
            table(spark, d, "lineitem").where(F.col("l_linestatus") == status)
            .groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("f"))
            .agg(F.sum("l_quantity").cast("long").alias("estimate"))
        )

    return tidy.left_join_keep(side("F"), side("O"), ["k", "f"], ("_bc", "_ra"))


@query(
    "join_sensitivity",
    """WITH s AS (SELECT l_partkey AS taxon, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1)
       SELECT taxon, score, p_size, CASE WHEN p_size > 25 THEN 'Significant' ELSE 'Nonsignificant' END AS diff
       FROM s LEFT JOIN part ON taxon = p_partkey""",
)
def join_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("taxon")).agg(
        F.sum("l_quantity").cast("long").alias("score")
    )
    calls = table(spark, d, "part").select(
        F.col("p_partkey").alias("taxon"), "p_size", (F.col("p_size") > 25).alias("diff")
    )
    return scores.join(calls, "taxon", "left").withColumn(
        "diff", tidy.recode(F.col("diff").cast("int"), {1: "Significant", 0: "Nonsignificant"})
    )


@query(
    "join_semi_anti",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer
         WHERE c_mktsegment <> 'MACHINERY') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem
         WHERE l_returnflag = 'R')""",
)
def join_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").selectExpr("c_custkey AS o_custkey")
    drop = table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS o_orderkey")
    return (
        table(spark, d, "orders").select("o_orderkey", "o_custkey")
        .join(keep, "o_custkey", "left_semi").join(drop, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")
    )


@query(
    "grid_complete",
    with_tables("samples")
    + """ SELECT d.diet, c.challenge, a.age, r.replicate, CAST(count(s.sample) AS BIGINT) AS n
          FROM (SELECT DISTINCT diet FROM samples) d CROSS JOIN (SELECT DISTINCT challenge FROM samples) c
          CROSS JOIN (SELECT DISTINCT age FROM samples) a CROSS JOIN (SELECT DISTINCT replicate FROM samples) r
          LEFT JOIN samples s ON s.diet = d.diet AND s.challenge = c.challenge AND s.age = a.age
            AND s.replicate = r.replicate GROUP BY 1, 2, 3, 4""",
)
def grid_complete(spark: SparkSession, d: str) -> DataFrame:
    # the last replicate is not there in every cell of the design
    s, fields = samples(spark, d), ["diet", "challenge", "age", "replicate"]
    return tidy.complete_grid(s.groupBy(*fields).agg(F.count("*").alias("n")), s, fields, {"n": 0})


# ---------------------------------------------------------------- sorting, sets


@query("sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    )


@query(
    "level_order",
    """WITH m AS (SELECT p_brand AS level, CAST(max(CAST(regexp_extract(p_brand, '\\d+') AS INT)) AS INT) AS key
                  FROM part GROUP BY 1)
       SELECT level, CAST(dense_rank() OVER (ORDER BY key DESC) AS INT) AS ord FROM m""",
)
def level_order(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_brand").alias("level"), S.numeric_id(F.col("p_brand")).alias("key"))
    return tidy.level_order(parts, "level", "key", descending=True)


@query(
    "greatest_p",
    """SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL
         ELSE greatest(d.n_chars, 1000 * l.quality) END AS worst FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def greatest_p(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels"), "doc_id", "left"
    )
    return joined.select(
        "doc_id", S.greatest_strict(F.col("n_chars"), (1000 * F.col("quality")).cast("long")).alias("worst")
    )


@query(
    "union_missing_columns",
    """SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS value FROM customer
       UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""",
)
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").selectExpr("c_custkey id", "c_mktsegment segment", "c_acctbal value")
    b = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal value")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "set_difference_union",
    """(SELECT l_suppkey AS k, l_partkey AS f FROM lineitem WHERE l_returnflag = 'A'
        EXCEPT ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
       UNION SELECT s_suppkey, s_suppkey FROM supplier""",
)
def set_difference_union(spark: SparkSession, d: str) -> DataFrame:
    def pick(flag: str) -> DataFrame:
        return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).selectExpr(
            "l_suppkey k", "l_partkey f"
        )

    extra = table(spark, d, "supplier").selectExpr("s_suppkey k", "s_suppkey f")
    return pick("A").exceptAll(pick("R")).union(extra).distinct()


# ---------------------------------------------------------------- reshape


@query(
    "unpivot_measures",
    """SELECT l_orderkey, l_linenumber, measure, value FROM
       (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
       UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))""",
)
def unpivot_measures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").unpivot(
        ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value"
    )


@query(
    "pivot_counts",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
         count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""",
)
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query(
    "transpose_table",
    """SELECT l_returnflag AS feature, CAST(sum(l_quantity) FILTER (l_linestatus = 'F') AS BIGINT) AS F,
         CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY 1""",
)
def transpose_table(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(
        F.sum("l_quantity").cast("long")
    )
    return tidy.transpose(wide, "l_linestatus", ["A", "N", "R"], ["F", "O"], "feature")


@query(
    "separate_fields",
    with_tables("samples")
    + """ SELECT name, string_split(name, '_')[1] AS trial, string_split(name, '_')[2] AS feed,
          string_split(name, '_')[3] AS challenge, string_split(name, '_')[4] AS age,
          string_split(name, '_')[7] AS absent FROM samples""",
)
def separate_fields(spark: SparkSession, d: str) -> DataFrame:
    # the fifth piece (replicate) is dropped by the four-name split; a seventh piece never exists
    parts = S.separate(F.col("name"), ["trial", "feed", "challenge", "age"], "_")
    absent = S.separate(F.col("name"), ["a", "b", "c", "d", "e", "f", "absent"], "_")["absent"]
    return samples(spark, d).select("name", *[c.alias(n) for n, c in parts.items()], absent.alias("absent"))


@query(
    "unnest_list",
    """SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding) AS value FROM embeddings""",
)
def unnest_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "dim", (F.col("dim") + 1).cast("long")
    )


@query(
    "parse_sample_code",
    with_tables("samples")
    + """ SELECT 't42_' || CASE WHEN diet = 'ctl' THEN CASE WHEN challenge = 'unc' THEN 1 ELSE 3 END
                 ELSE CASE WHEN challenge = 'unc' THEN 2 ELSE 4 END END || '_' || age || '_' || (replicate % 10) AS code,
            't42' AS trial, diet || '_' || challenge AS treatment, CAST(age AS INT) AS age,
            CAST(replicate % 10 AS VARCHAR) AS replicate FROM samples""",
)
def parse_sample_code(spark: SparkSession, d: str) -> DataFrame:
    digit = "CASE WHEN diet = 'ctl' THEN IF(challenge = 'unc', 1, 3) ELSE IF(challenge = 'unc', 2, 4) END"
    codes = samples(spark, d).selectExpr(f"concat_ws('_', 't42', {digit}, age, replicate % 10) AS code")
    return tidy.parse_sample_code(codes, "code")


# ---------------------------------------------------------------- scalar functions


@query(
    "str_concat",
    """SELECT d.doc_id, d.lang || '_' || coalesce(CAST(l.quality AS VARCHAR), 'NA') AS label
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def str_concat(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", S.paste("lang", "quality", sep="_").alias("label"))


@query(
    "str_substring",
    """SELECT s_name, substr(s_name, 3, 8) AS mid, right(s_name, 3) AS tail, substr(s_name, 6) AS rest FROM supplier""",
)
def str_substring(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_name", S.str_sub(x, 3, 10).alias("mid"), S.str_sub(x, -3, -1).alias("tail"), S.str_sub(x, 6).alias("rest")
    )


@query(
    "regex_extract",
    with_tables("taxonomy")
    + r""" SELECT feature, nullif(regexp_extract(taxonomy, '\(([^)]+)\)', 1), '') AS inside,
             nullif(regexp_extract(taxonomy, '^[^(]+', 0), '') AS head,
             CAST(NULL AS VARCHAR) AS missing FROM taxonomy""",
)
def regex_extract(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("taxonomy")
    return taxonomy(spark, d).select(
        "feature",
        S.str_extract(x, r"(?<=\().+?(?=\))").alias("inside"),
        S.str_extract(x, r"^[^\(]+").alias("head"),
        S.str_extract(x, r"Otu\d{4}").alias("missing"),
    )


@query(
    "regex_replace_first",
    r"""SELECT c_custkey, regexp_replace(c_name, '00', '') AS first_removed,
          regexp_replace(c_name, '#0+', '_') AS replaced FROM customer""",
)
def regex_replace_first(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", S.str_replace_first(x, "00").alias("first_removed"),
        S.str_replace_first(x, "#0+", "_").alias("replaced"),
    )


@query(
    "regex_count",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]+th')) AS INT) AS hits,
          regexp_matches(text, '\|') AS has_bar FROM documents""",
)
def regex_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.regexp_count("text", F.lit("[a-z]+th")).alias("hits"), F.col("text").rlike(r"\|").alias("has_bar")
    )


@query(
    "parse_taxonomy",
    r"""SELECT p_partkey AS feature, CAST(r AS INT) AS rank, CASE r WHEN 1 THEN p_type WHEN 2 THEN p_brand
          ELSE p_name END AS name, CAST(CASE r WHEN 1 THEN 100 WHEN 2 THEN 95 ELSE 80 END AS INT) AS conf
        FROM part, range(1, 4) t(r)""",
)
def parse_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy(spark, d).select("feature", F.inline(S.parse_taxonomy(F.col("taxonomy"))))


@query(
    "safe_cast",
    r"""SELECT doc_id, TRY_CAST(replace(lang, 'en', '12.5') AS DOUBLE) AS number,
          CAST(TRY_CAST(regexp_replace(source, 'src', '') AS DOUBLE) AS INT) AS whole FROM documents""",
)
def safe_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        S.as_numeric(F.regexp_replace("lang", "en", "12.5")).alias("number"),
        S.as_integer(F.regexp_replace("source", "src", "")).alias("whole"),
    )


@query(
    "log_transforms",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '-inf' ELSE 'finite' END AS kind,
         CASE WHEN l_discount > 0 THEN round(ln(l_discount), 6) END AS ln_d,
         round(log10(l_quantity), 6) AS log10_q, round(pow(10, l_tax), 6) AS pow_t, abs(l_tax - 0.04) AS abs_t
       FROM lineitem""",
)
def log_transforms(spark: SparkSession, d: str) -> DataFrame:
    ln = S.log_or_limit(F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(ln == float("-inf"), "-inf").otherwise("finite").alias("kind"),
        F.round(F.when(ln > float("-inf"), ln), 6).alias("ln_d"),
        F.round(S.log_or_limit(F.col("l_quantity"), base10=True), 6).alias("log10_q"),
        F.round(F.pow(F.lit(10.0), F.col("l_tax")), 6).alias("pow_t"),
        F.abs(F.col("l_tax") - 0.04).alias("abs_t"),
    )


@query(
    "round_signif",
    """SELECT o_orderkey, round_even(o_totalprice, 1) AS r1,
         CASE WHEN o_totalprice = 0 THEN 0.0 WHEN floor(log10(o_totalprice)) >= 2
           THEN round_even(o_totalprice / pow(10, floor(log10(o_totalprice)) - 2), 0)
                * pow(10, floor(log10(o_totalprice)) - 2)
           ELSE round_even(o_totalprice * pow(10, 2 - floor(log10(o_totalprice))), 0)
                / pow(10, 2 - floor(log10(o_totalprice))) END AS s3 FROM orders""",
)
def round_signif(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.bround(x, 1).alias("r1"), S.signif(x, 3).alias("s3"))


@query(
    "stage_label",
    with_tables("samples") + " SELECT name, age || ' (' || (age - 20) || ')' AS stage FROM samples",
)
def stage_label(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("name", S.stage_label(F.col("age")).alias("stage"))


@query(
    "array_math",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n,
         round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean,
         round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS ss FROM embeddings""",
)
def array_math(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    ss = F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, d, "embeddings").select(
        "vec_id", F.size("embedding").alias("n"), F.round(total / F.size("embedding"), 6).alias("mean"),
        F.round(ss, 6).alias("ss"),
    )


@query(
    "significance_class",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**'
         WHEN l_discount < 0.05 THEN '*' ELSE 'ns' END AS sig,
         CASE WHEN l_discount > 0.05 OR l_tax > 0.05 THEN 'p.adj > 0.05' WHEN l_quantity - 25 < 0 THEN 'Negative LFC'
         WHEN l_quantity - 25 > 0 THEN 'Positive LFC' END AS class FROM lineitem""",
)
def significance_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.stars(F.col("l_discount"), "ns").alias("sig"),
        S.effect_class(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") - 25).alias("class"),
    )


@query(
    "numeric_id",
    """SELECT c_custkey, CAST(regexp_extract(c_name, '\\d+') AS INT) AS ord FROM customer""",
)
def numeric_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.numeric_id(F.col("c_name")).alias("ord"))


@query(
    "row_sum",
    """SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem""",
)
def row_sum(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return df.select(
        "l_orderkey", "l_linenumber", F.round(S.row_sum(df, ["l_quantity", "l_discount", "l_tax"]), 6).alias("total")
    )


