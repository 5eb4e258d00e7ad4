"""Sharding along a Hilbert curve through several metadata dimensions, cut into runs of equal row counts.

Rows near each other on the curve are near in every dimension, so the range of each dimension inside a shard is
narrow and a filter on any of them skips most shards (``shard_ranges``, ``matching_shards``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import global_rank

BITS = 6


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of ``cells`` (rows x dimensions, each below ``2**bits``)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # from the axes to the transposed index: undo the rotations from the highest bit down
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            inside = (x[d] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> bit) & 1)
    return out


def string_quantiles(df: DataFrame, column: str, at: list[float]) -> list[str]:
    """The distinct values at these shares of all rows in order, nulls aside.

    Equal values are one row with their count; ranges of values get the counts of earlier ranges, one number each.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = checkpointed(values.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    firsts, total = [], 0
    for row in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row per partition
        firsts.append((row["part"], total))
        total += row["n"]
    if not total:
        return []
    first = spark.createDataFrame(firsts, "part int, first long")
    upto = F.col("first") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = placed.join(F.broadcast(first), "part").withColumn("upto", upto)
    places = F.array(*[F.lit(min(total - 1, int(q * total))) for q in at])
    found = ranked.where(F.exists(places, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))))
    return sorted(r["v"] for r in found.select("v").collect())  # at most one row per share


def cut_points(df: DataFrame, dims: list[str], id_col: str, bits: int) -> list[np.ndarray]:
    """Up to ``2**bits - 1`` ascending values of each dimension: quantiles of numbers, and of whole strings.

    A fixed number of values comes to the driver, numbers by a sketch, strings by their counts, both over all rows.
    """
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    edges = {}
    if numbers:
        found = df.agg(*[F.percentile_approx(F.col(d).cast("double"), at, 10_000).alias(f"d{dims.index(d)}") for d in numbers]).first()
        edges = {d: np.array(found[f"d{dims.index(d)}"] or [], float) for d in numbers}
    edges |= {d: np.array(string_quantiles(df, d, at), object) for d in dims if d not in edges}
    return [edges[d] for d in dims]


def with_curve(df: DataFrame, dims: list[str], id_col: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``hilbert``: each dimension quantised at its ``2**bits`` quantiles, null to the first cell.

    The cut points are fixed values in the plan, so a row that is computed again gets the same cell; any cut points
    give a valid order.
    """
    if bits * len(dims) > 62:
        raise ValueError("a curve index has at most 62 bits")
    edges = cut_points(df, dims, id_col, bits)

    @F.pandas_udf("long")
    def curve(values: pd.DataFrame) -> pd.Series:
        cells = []
        for e, (_, v) in zip(edges, values.items()):
            cell = np.zeros(len(v), np.int64)
            known = v.notna().to_numpy()
            cell[known] = np.searchsorted(e, v[known].to_numpy(dtype=e.dtype), side="right")
            cells.append(cell)
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    kinds = dict(df.dtypes)
    own = [F.col(d) if kinds[d] == "string" else F.col(d).cast("double") for d in dims]
    return df.withColumn("hilbert", curve(F.struct(*[c.alias(f"d{k}") for k, c in enumerate(own)])))


def assign_shards(df: DataFrame, dims: list[str], id_col: str, shards: int, bits: int = BITS) -> DataFrame:
    """``df`` with ``hilbert``, ``shard`` and ``slot``: the curve order cut into runs at most one row apart.

    Row ``r`` of ``n`` goes to shard ``r * shards div n``; ``slot`` counts from 0 in a shard. Rows on the same cell
    follow by a hash of the id, so a cell that holds a third of all rows is still split. Pass only the columns
    that are needed: rows are written once and shuffled twice. An empty table gives an empty one.
    """
    keyed = with_curve(df, dims, id_col, bits).withColumn("__hash", F.xxhash64(id_col))
    ranked, n = global_rank(keyed, "hilbert", "__hash", id_col)
    n = max(n, 1)
    shard = F.expr(f"CAST(__rank * {shards} div {n} AS INT)")
    return ranked.withColumn("shard", shard).withColumn(
        "slot", F.expr(f"__rank - (CAST(shard AS BIGINT) * {n} + {shards - 1}) div {shards}")
    ).drop("__hash", "__rank")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order, so that file statistics are narrow in every dimension."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(df: DataFrame, dims: list[str]) -> DataFrame:
    """Smallest and largest value of each dimension by shard: what a reader needs to skip files."""
    return df.groupBy("shard").agg(
        F.count("*").alias("rows"),
        *[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))],
    )


def matching_shards(ranges: DataFrame, **wanted: tuple) -> DataFrame:
    """The shards whose ranges meet ``dim=(low, high)`` in every given dimension."""
    for dim, (low, high) in wanted.items():
        ranges = ranges.where((F.col(f"max_{dim}") >= low) & (F.col(f"min_{dim}") <= high))
    return ranges.select("shard")
