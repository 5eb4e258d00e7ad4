"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate.

DataFrame functions only. A line is compared after trimming blanks at its ends; blank lines are always kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Boilerplate tables of at most so many lines are broadcast (16 bytes each); larger ones are joined by salted host.
BROADCAST_LINES = 1_000_000
SALTS = 64


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """``(host, hash, n, total)``: lines on more than ``ratio`` of a host's pages and on ``min_pages`` at least.

    Each page gives every distinct line once, by 64-bit hash inside its host. Counts are combined before the
    shuffle, so a line or host that holds a third of all rows is one row per task. Rare lines go before totals
    are joined.
    """
    own = pages.where(F.col(host).isNotNull())
    lines = own.select(
        F.col(host).alias("host"),
        F.explode(F.array_distinct(F.transform(_lines(text), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x)))))).alias("hash"),
    ).where("hash IS NOT NULL")
    often = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = own.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total"))
    return often.join(totals, "host").where(F.col("n") / F.col("total") > ratio)


def drop_site_lines(pages: DataFrame, host: str, text: str, ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``pages`` with its columns, ``text`` without its host's boilerplate, ``n_lines`` and ``n_dropped``.

    Every row stays, also where no line is left. Null text or host: unchanged, nothing dropped. Repeated rows
    count as pages of their own. A host's list of boilerplate hashes is at most its mean number of lines per
    page over ``ratio``; page texts are not shuffled unless the whole list is over ``BROADCAST_LINES``.
    """
    found = checkpointed(boilerplate(pages, host, text, ratio, min_pages))
    lists = found.groupBy(F.col("host").alias("__host")).agg(F.collect_list("hash").alias("__hashes"))
    if found.count() <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(lists), F.col(host) == F.col("__host"), "left")
    else:
        salted = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        turn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("__turn", turn).join(
            salted, (F.col(host) == F.col("__host")) & (F.col("__turn") == F.col("__salt")), "left"
        )
    digest = F.transform(_lines(text), lambda x: F.xxhash64(F.trim(x)))
    marked = joined.withColumn(
        "__drop", F.when(F.col("__hashes").isNotNull(), F.array_intersect(digest, F.col("__hashes")))
    )
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains("__drop", F.xxhash64(F.trim(x))))
    n_lines = F.when(F.col(text).isNotNull(), F.size(_lines(text))).otherwise(0).cast("long")
    cut = marked.withColumn("__kept", F.when(F.size("__drop") > 0, kept))
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(
        *[F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in names],
        n_lines.alias("n_lines"),
        F.when(F.col("__kept").isNotNull(), n_lines - F.size("__kept")).otherwise(0).cast("long").alias("n_dropped"),
    )
