"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing. Each stage works on
all rows that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import decontaminate, gray_simhash, quality_fm, residual_packing, site_lines
from tallyfield.llm.queries import table, vocabulary
from tallyfield.session import scratch_path, ship_package

#: The classifier, the packing and the links of fingerprints have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at least 0.3."""
    ship_package(spark)
    model = quality_fm.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_fm.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars`` follows the text."""
    ship_package(spark)
    cut = site_lines.drop_site_lines(docs, "source", "text")
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints."""
    ship_package(spark)
    return gray_simhash.keep_first(docs, gray_simhash.near_duplicates(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a benchmark window."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, decontaminate.benchmark_blocks(table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and offset."""
    ship_package(spark)
    return residual_packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_fm", quality), ("site_lines", lines), ("gray_simhash", near_duplicates), ("decontaminate", benchmark),
    ("residual_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on; the last one's result is read from its written table, too."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
