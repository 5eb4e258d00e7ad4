"""The analysis tables, derived by Spark from the star-schema and text tables at hand.

Each function reads the given parquet folder and returns a whole table in the canonical long form:
samples with their design, counts, taxonomy, measures and sequence collections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread_scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for per-character work, on as many tasks as there are cores."""
    return spread_scan(table(spark, folder, "documents"), "doc_id")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample with the crossed design and its packed name."""
    return (
        table(spark, folder, "supplier")
        .selectExpr(
            "s_suppkey AS sample",
            "IF(s_suppkey % 2 = 0, 'ctl', 'gos') AS diet",
            "IF((s_suppkey div 2) % 2 = 0, 'unc', 'sal') AS challenge",
            "element_at(array(22, 24, 28, 35), CAST((s_suppkey div 4) % 4 + 1 AS INT)) AS age",
            "s_suppkey div 16 AS replicate",
        )
        .withColumn("name", F.concat_ws("_", F.lit("l"), "diet", "challenge", "age", "replicate"))
    )


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse sample x feature counts; absent cells are zero."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"))
        .agg(F.sum("l_quantity").cast("long").alias("reads"))
    )


def genus_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts agglomerated to the 25 brands, so that almost every cell is filled."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    return (
        table(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("sample"), "feature")
        .agg(F.sum("l_quantity").cast("long").alias("reads"))
    )


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("feature"),
        F.format_string("%s(100);%s(95);%s(80);", "p_type", "p_brand", "p_name").alias("taxonomy"),
    )


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """A continuous measure by cohort inside strata."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("unit"),
        F.col("o_orderstatus").alias("stratum"),
        F.col("o_orderpriority").alias("cohort"),
        F.col("o_totalprice").alias("value"),
    )


def analytes(spark: SparkSession, folder: str) -> DataFrame:
    """Analyte amount per sample in whole hundredths; several event users share a sample."""
    n = table(spark, folder, "supplier").count()  # one number
    return (
        table(spark, folder, "events")
        .groupBy((F.col("user_id") % n).alias("sample"), F.col("event_type").alias("analyte"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"))
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence reads: every line of every document, with the document's source as sample."""
    return (
        texts(spark, folder)
        .select(
            "doc_id", F.col("source").alias("sample"), F.posexplode(F.split("text", "\n")).alias("pos", "seq")
        )
        .where(F.length("seq") > 0)
    )


def unique_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct lines with their digest as id and their number of copies."""
    return (
        lines(spark, folder)
        .groupBy("seq")
        .agg(F.count("*").alias("n"))
        .select(F.md5("seq").alias("seq_id"), "seq", "n")
    )


def reference_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Reference sequences: the distinct lines of the benchmark texts."""
    return (
        table(spark, folder, "benchmark")
        .select(F.explode(F.split("text", "\n")).alias("seq"))
        .where(F.length("seq") > 0)
        .distinct()
        .select(F.md5("seq").alias("ref_id"), "seq")
    )
