"""Multiple-comparison adjustment inside strata of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranks import join_null_safe, value_splits, with_value_range

_RANGE = "_prange"


def _p_counts(df: DataFrame, strata: list[str], p: str) -> DataFrame:
    """Distinct p-values with their cumulative count ``upto`` and the stratum's ``m``."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    counts = with_value_range(
        rows.groupBy(*strata, p).agg(F.count("*").alias("_n")), p, value_splits(rows, p), _RANGE
    )
    per = counts.groupBy(*strata, _RANGE).agg(F.sum("_n").alias("_in"))
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    offs = per.select(
        *strata,
        _RANGE,
        F.coalesce(
            F.sum("_in").over(w.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_in").over(w).alias("_m"),
    )
    local = F.sum("_n").over(
        Window.partitionBy(*strata, _RANGE).orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return join_null_safe(counts.withColumn("_loc", local), offs, [*strata, _RANGE]).withColumn(
        "_upto", F.col("_loc") + F.col("_before")
    )


def _carry(table: DataFrame, strata: list[str], p: str, raw: Column, suffix: bool) -> DataFrame:
    """Running min from the top (``suffix``) or running max from the bottom, across ranges."""
    fold = F.min if suffix else F.max
    bound = F.least if suffix else F.greatest
    t = table.withColumn("_raw", raw)
    order = F.col(p).desc() if suffix else F.col(p).asc()
    inner = Window.partitionBy(*strata, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = t.groupBy(*strata, _RANGE).agg(fold("_raw").alias("_best"))
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    key = F.col(_RANGE).desc() if suffix else F.col(_RANGE).asc()
    others = per.select(
        *strata,
        _RANGE,
        fold("_best").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)).alias("_outer"),
    )
    done = join_null_safe(t.withColumn("_inner", fold("_raw").over(inner)), others, [*strata, _RANGE])
    return done.select(
        *strata, p, F.least(bound("_inner", F.coalesce("_outer", "_inner")), F.lit(1.0)).alias("_adj")
    )


def _attach(df: DataFrame, adjusted: DataFrame, strata: list[str], p: str, name: str) -> DataFrame:
    return join_null_safe(df, adjusted, [*strata, p], "left").withColumnRenamed("_adj", name)


def adjust_bh(df: DataFrame, strata: Sequence[str], p: str, name: str = "p_adj", materialize: bool = True) -> DataFrame:
    """Benjamini-Hochberg within ``strata``; NULL p-values are not counted and stay NULL.

    ``materialize`` writes the incoming result table once, because it is read for the counts and
    again for the final join.
    """
    strata = list(strata)
    src = checkpointed(df) if materialize else df
    table = _p_counts(src, strata, p)
    adj = _carry(table, strata, p, F.col(p) * F.col("_m") / F.col("_upto"), suffix=True)
    return _attach(src, adj, strata, p, name)


def adjust_holm(
    df: DataFrame, strata: Sequence[str], p: str, name: str = "p_adj", materialize: bool = True
) -> DataFrame:
    """Holm within ``strata``. Among equal p-values the first one carries the largest factor."""
    strata = list(strata)
    src = checkpointed(df) if materialize else df
    table = _p_counts(src, strata, p)
    first = F.col("_upto") - F.col("_n") + 1
    adj = _carry(table, strata, p, F.col(p) * (F.col("_m") - first + 1), suffix=False)
    return _attach(src, adj, strata, p, name)
