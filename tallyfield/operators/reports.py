"""Small report tables built from grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number_text, signif
from .ranks import attach


def mean_by_unit(df: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """Pseudo-replicates averaged to their experimental unit, with their number."""
    return df.groupBy(*unit).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def mean_sem(df: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Mean with bounds at one standard error."""
    sem = F.col("sd") / F.sqrt("n")
    return (
        df.groupBy(*strata)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
        .withColumns({"ymin": F.col("mean") - sem, "ymax": F.col("mean") + sem})
    )


def count_percent_table(df: DataFrame, strata: Sequence[str], status: str, levels: Sequence[str]) -> DataFrame:
    """``n (pct%)`` per status level, percentages of the stratum to three significant digits."""
    wide = df.groupBy(*strata).agg(*[F.count_if(F.col(status) == lv).alias(lv) for lv in levels])
    total = sum(F.col(lv) for lv in levels)
    cell = {lv: 100 * (F.col(lv) / total) for lv in levels}
    return wide.withColumns(
        {
            lv: F.concat(F.col(lv).cast("string"), F.lit(" ("), number_text(signif(pc, 3)), F.lit("%)"))
            for lv, pc in cell.items()
        }
    )


def with_totals(counts: DataFrame) -> DataFrame:
    """Cells plus one total row per sample (feature NULL), in one pass by grouping sets."""
    return (
        counts.groupingSets([["sample", "feature"], ["sample"]], "sample", "feature")
        .agg(F.sum("reads").alias("reads"))
        .select("sample", "feature", "reads")
    )


def list_by_group(df: DataFrame, keys: Sequence[str], value: str, name: str, most: int = 100_000) -> DataFrame:
    """Sorted values of a group in one array. Only for groups bounded by the design: one of over ``most`` rows is an error."""
    largest = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group has {largest} values, more than the {most} that one list may hold")
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def keep_complete(n: DataFrame, unit: str, sizes: Sequence[str], strata: int) -> DataFrame:
    """Units whose group sizes are the same in at least ``strata`` strata."""
    same = n.groupBy(unit, *sizes).agg(F.count("*").alias("_k")).where(F.col("_k") >= strata).select(unit)
    return n.join(same, unit, "left_semi")


def join_text(df: DataFrame, keys: Sequence[str], value: str, sep: str, name: str) -> DataFrame:
    """Ordered concatenation of distinct labels (bounded by the number of labels)."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(name))


def count_where(df: DataFrame, keys: Sequence[str], predicates: dict[str, str]) -> DataFrame:
    """Row counts under several predicates in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(F.expr(p)).alias(n) for n, p in predicates.items()])


def centre_in_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value minus its group mean, rows kept. The mean is a combined aggregate joined back, so a
    group holding a third of the rows is not gathered in one window task."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count("*").alias("n"))
    return attach(df, g, keys).withColumn("centred", F.col(value) - F.col("_m")).drop("_m")
