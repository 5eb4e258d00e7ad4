"""Column selection, recoding, filtering of count tables, joins and reshaping on long tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_taxonomy, str_sub
from .ranks import join_null_safe

# Molecular weights (g/mol) used for ppm -> mM (fixed values). Butyrate is given as 178.23 in the
# published calculation although its isomer isobutyric acid is 88.11.
MOL_WT = {
    "Acetic acid": 60.05,
    "Propionate": 74.08,
    "Isobutyric acid": 88.11,
    "Butyrate": 178.23,
    "2-Methyl butyric acid": 102.13,
    "Isovaleric acid": 102.13,
    "Valerate": 102.13,
    "Hexanoic acid": 116.16,
    "Lactic acid": 90.08,
}
PPB = {"Isobutyric acid"}  # reported in ppb, brought to ppm first


def columns_matching(
    df: DataFrame, starts_with: str = "", ends_with: str = "", contains: str = "", regex: str | None = None
) -> list[str]:
    return [
        c
        for c in df.columns
        if c.startswith(starts_with) and c.endswith(ends_with) and contains in c
        and (regex is None or re.search(regex, c))
    ]


def columns_of_type(df: DataFrame, kind: type) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kind)]


def rename_by_pattern(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def relocate(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def slice_from_second(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Drop the first row (by ``order``) of each key; ``order`` is unique within a key.

    The first row is found by a map-side-combined minimum, not by numbering each group's rows.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, list(keys)).where(F.col(order) > F.col("_first")).drop("_first")


def recode(col: Column, mapping: dict) -> Column:
    """Value recode; values outside the mapping become NULL."""
    return reduce(lambda w, kv: w.when(col == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), F.lit(None)))


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def analyte_constants(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """``(analyte, mol_wt, factor)`` for analyte name -> compound."""
    rows = [(k, MOL_WT[v], 0.001 if v in PPB else 1.0) for k, v in names.items()]
    return spark.createDataFrame(rows, "analyte string, mol_wt double, factor double")


def to_millimolar(values: DataFrame, constants: DataFrame) -> DataFrame:
    """ppm (or ppb, by ``factor``) to mM; the constants table has one row per analyte."""
    mm = (F.col("value") * F.col("factor") / 1000) / F.col("mol_wt") * 1000
    return values.join(F.broadcast(constants), "analyte").withColumn("mM", mm).drop("mol_wt", "factor")


def depth_prevalence_filter(
    counts: DataFrame, samples: DataFrame, min_depth: int = 50, min_prevalence: float = 0.1
) -> DataFrame:
    """Keep features that reach ``min_depth`` somewhere and occur in enough samples.

    Cells are sparse, so prevalence is counted over the sample dimension, not over stored rows.
    """
    n = samples.count()
    kept = (
        counts.groupBy("feature")
        .agg(F.max("reads").alias("_deepest"), F.count_if(F.col("reads") > 0).alias("_present"))
        .where((F.col("_deepest") >= min_depth) & (F.col("_present") >= min_prevalence * n))
        .select("feature")
    )
    return counts.join(kept, "feature", "left_semi").select(*counts.columns)


def drop_samples(counts: DataFrame, drop: DataFrame) -> DataFrame:
    """Remove samples, then features left without reads."""
    kept = counts.join(drop, "sample", "left_anti")
    alive = kept.groupBy("feature").agg(F.sum("reads").alias("_t")).where("_t > 0").select("feature")
    return kept.join(alive, "feature", "left_semi").select(*counts.columns)


def lineage_filter(
    counts: DataFrame, taxa: DataFrame, keep: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Keep features whose lineage holds any of ``keep`` and none of ``exclude``."""
    names = F.transform(parse_taxonomy(F.col("taxonomy")), lambda r: r["name"])
    cond = F.lit(True)
    if keep:
        cond = cond & F.arrays_overlap(names, F.array(*[F.lit(k) for k in keep]))
    if exclude:
        cond = cond & ~F.arrays_overlap(names, F.array(*[F.lit(k) for k in exclude]))
    return counts.join(taxa.where(cond).select("feature"), "feature", "left_semi").select(*counts.columns)


def library_size_filter(counts: DataFrame, lib_cut: int) -> DataFrame:
    deep = counts.groupBy("sample").agg(F.sum("reads").alias("_t")).where(F.col("_t") >= lib_cut).select("sample")
    return counts.join(deep, "sample", "left_semi").select(*counts.columns)


def lookup(results: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a result table for a literal key list, fetched together."""
    return results.join(F.broadcast(keys), keys.columns, "left_semi")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all shared columns; a missing key matches a missing key, as in the statistical language."""
    return join_null_safe(left, right, [c for c in left.columns if c in right.columns], "left")


def left_join_keep(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Left join that keeps both sides' keys, every column suffixed; a missing key matches a missing key."""
    a = left.toDF(*[c + suffixes[0] for c in left.columns])
    b = right.toDF(*[c + suffixes[1] for c in right.columns])
    cond = reduce(lambda x, y: x & y, [F.col(k + suffixes[0]).eqNullSafe(F.col(k + suffixes[1])) for k in keys])
    return a.join(b, cond, "left")


def complete_grid(df: DataFrame, dimension: DataFrame, levels: Sequence[str], fill: dict) -> DataFrame:
    """All combinations of the design levels; absent cells get ``fill``.

    The level lists come from one aggregation and are exploded one after another, so the grid is
    built from a single row. Factor levels are bounded by the design.
    """
    grid = dimension.agg(*[F.collect_set(c).alias(c) for c in levels])
    for c in levels:
        grid = grid.withColumn(c, F.explode(c))
    return grid.join(df, list(levels), "left").na.fill(fill)


def level_order(df: DataFrame, level: str, key: str, descending: bool = False) -> DataFrame:
    """Level table with its position by another column; the distinct levels are few."""
    top = df.groupBy(F.col(level).alias("level")).agg(F.max(key).alias("key"))
    order = F.col("key").desc() if descending else F.col("key").asc()
    return top.select("level", F.dense_rank().over(Window.orderBy(order)).alias("ord"))


def transpose(
    wide: DataFrame, key: str, columns: Sequence[str], key_values: Sequence[str], name: str
) -> DataFrame:
    """Swap rows and columns: long form, then pivot on the former key with explicit values."""
    long = wide.unpivot([key], list(columns), name, "value")
    return long.groupBy(name).pivot(key, list(key_values)).agg(F.first("value"))


def parse_sample_code(df: DataFrame, code: str) -> DataFrame:
    """Fixed-position code: trial 1-3, cohort digit 5, age 7-8, last character replicate."""
    x = F.col(code)
    cohort = recode(
        F.substring(x, 5, 1), {"1": "ctl_unc", "2": "gos_unc", "3": "ctl_sal", "4": "gos_sal"}
    )
    return df.select(
        code, F.substring(x, 1, 3).alias("trial"), cohort.alias("treatment"),
        F.substring(x, 7, 2).try_cast("int").alias("age"), str_sub(x, -1, -1).alias("replicate"),
    )


def effects_listing(
    results: DataFrame, effect: str, flag: Column, order_by: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Significant rows, largest effect first, with the sign as text; ``limit`` gives a top-k report."""
    out = results.where(flag).withColumn(
        "direct", F.when(F.col(effect) > 0, "Positive LFC").otherwise("Negative LFC")
    )
    out = out.orderBy(F.col(effect).desc(), *order_by)
    return out.limit(limit) if limit else out
