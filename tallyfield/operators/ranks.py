"""Ranks, quantiles and cumulative counts that never put one stratum into one task.

A window ``PARTITION BY stratum ORDER BY value`` sends a whole stratum to one task. Here equal
values are first collapsed to counts (map-side), the distinct values are cut into ranges, running
sums are taken inside each ``(stratum, range)``, and the counts of the earlier ranges are added
from a table with at most one row per range. The cut points only balance the work; any cut points
give the same ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, bucket_count, checkpointed

_RANGE = "_range"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the right copies of the keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group result (one row per ``keys``) back to rows.

    The result is written once and counted: under the size bound it is broadcast, so rows of a hot group
    are not moved; beyond it a shuffle join runs, whose skewed side adaptive execution splits.
    """
    small = checkpointed(groups)
    return join_null_safe(df, broadcast_if_small(small, small.count(), 32 * len(small.columns)), keys, how)


def value_splits(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Cut points that balance the rows of ``value`` (one sketch aggregate over one column)."""
    buckets = buckets or bucket_count(df.sparkSession)
    # one SQL text instead of a Column per probability
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    row = df.selectExpr(f"percentile_approx(CAST(`{value}` AS DOUBLE), array({probs}), {8 * buckets}) AS s").first()
    inner = sorted({float(s) for s in (row["s"] or []) if s is not None and s == s and abs(s) != float("inf")})
    return [-float("inf"), *inner, float("inf")]


def with_value_range(df: DataFrame, value: str, splits: list[float], name: str = _RANGE) -> DataFrame:
    """Add the index of the range holding ``value``; ranges are ordered like the values."""
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0))
    tmp = df.withColumn("_v", F.col(value).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_v", outputCol=name, handleInvalid="keep").transform(tmp)
    return out.withColumn(name, F.col(name).cast("int")).drop("_v")


def _range_offsets(df: DataFrame, strata: list[str], n: str) -> DataFrame:
    """Per (stratum, range): rows in earlier ranges and rows of the stratum."""
    per = df.groupBy(*strata, _RANGE).agg(F.sum(n).alias("_in"))
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    before = F.sum("_in").over(w.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    return per.select(
        *strata, _RANGE, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_in").over(w).alias("total")
    )


def rank_table(
    df: DataFrame,
    strata: Sequence[str],
    value: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct ``(strata, by, value)`` with its position in the stratum.

    Adds ``n`` (rows, or summed ``weight``), ``ties`` (rows of the stratum with this value),
    ``below`` (rows with a smaller value), ``midrank``, ``maxrank`` and ``total``. NULL values do
    not take part.
    """
    strata, by = list(strata), list(by)
    clash = {"n", "ties", "below", "midrank", "maxrank", "total"} & {*strata, *by, value}
    if clash:
        raise ValueError(f"rename input columns {sorted(clash)}: the rank table uses these names")
    rows = df.where(F.col(value).isNotNull())
    splits = value_splits(rows, value, buckets)
    counts = rows.groupBy(*strata, *by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    counts = with_value_range(counts, value, splits)
    part = Window.partitionBy(*strata, _RANGE)
    # both frames share one sort
    upto = F.sum("n").over(part.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("n").over(part.orderBy(value).rangeBetween(Window.currentRow, Window.currentRow))
    local = counts.withColumns({"_upto": upto, "ties": ties})
    placed = join_null_safe(local, _range_offsets(counts, strata, "n"), [*strata, _RANGE])
    maxrank = F.col("_upto") + F.col("_before")
    return placed.select(
        *strata,
        *by,
        value,
        "n",
        "ties",
        (maxrank - F.col("ties")).alias("below"),
        (maxrank - F.col("ties") + (F.col("ties") + 1) / 2.0).alias("midrank"),
        maxrank.alias("maxrank"),
        "total",
    )


def with_rank(df: DataFrame, strata: Sequence[str], value: str, kind: str = "midrank", name: str = "rank") -> DataFrame:
    """Every row of ``df`` with its rank inside ``strata``.

    The rank table is unique on (strata, value), so a value held by a third of the rows makes only
    the row side of the join skewed, which adaptive skew joins split.
    """
    strata = list(strata)
    ranks = rank_table(df, strata, value).select(*strata, value, F.col(kind).alias(name))
    return join_null_safe(df, ranks, [*strata, value], "left")


def window_ranks(strata: Sequence[str], value: str) -> tuple[Column, Column]:
    """``(midrank, maxrank)`` window columns for strata with a structural bound.

    Use only where a stratum holds at most one row per sample or per factor level.
    """
    maxrank = F.count("*").over(Window.partitionBy(*strata).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*strata, value))
    return maxrank - (ties - 1) / 2.0, maxrank


def quantiles(
    df: DataFrame, strata: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated (type 7) quantiles per stratum, one column per entry of ``probs``.

    The two order statistics around each probability are picked from the rank table; nothing
    gathers a stratum's values.
    """
    strata = list(strata)
    table = rank_table(df, strata, value, weight=weight)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo = F.floor(pos) + 1
        hi = F.least(lo + 1, F.col("total"))
        holds = lambda k: (F.col("below") < k) & (F.col("maxrank") >= k)
        v = F.col(value).cast("double")
        aggs += [
            F.max(F.when(holds(lo), v)).alias(f"_lo_{name}"),
            F.max(F.when(holds(hi), v)).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_fr_{name}"),
        ]
    picked = table.groupBy(*strata).agg(F.max("total").alias("n"), *aggs)
    return picked.select(
        *strata,
        "n",
        *[
            (F.col(f"_lo_{q}") + F.col(f"_fr_{q}") * (F.col(f"_hi_{q}") - F.col(f"_lo_{q}"))).alias(q)
            for q in probs
        ],
    )
