"""Two-parent chimeras by neighbours in sorted order.

Among strings in lexicographic order the one that shares the longest start with a given string is next to it, so of the
parents that are abundant enough only the two nearest on each side can be the best or the second best. Starts are looked up in
the order of the strings, ends in the order of the reversed ones. Where the abundant strings are few, all tasks have them in
order. Where they are many, the order of all strings is cut into ranges of equal size, whatever the samples; what a range needs of the others are the strings at its borders that no two nearer ones outdo in count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_BYTES, checkpointed
from .ranks import attach, join_null_safe


def common_start(a: str, b: str) -> int:
    """Number of characters that two strings have in common from the first on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = min(high, 2 * low + 8)  # gallop: twice as far as is known
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
            break
    while low < high:  # the first difference lies in low .. high - 1, or there is none
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def outstanding(counts: list[int], nearest_last: bool) -> list[int]:
    """Places of the elements that fewer than two elements nearer to the border reach in count, in order."""
    best, second = -1, -1
    keep = []
    for i in range(len(counts) - 1, -1, -1) if nearest_last else range(len(counts)):
        n = counts[i]
        if n > second:
            keep.append(i)
            best, second = (n, best) if n > best else (best, n)
    return keep[::-1] if nearest_last else keep


def _tables(values: np.ndarray, take) -> list[np.ndarray]:
    """``take`` (largest or smallest) over every run of 1, 2, 4, .. values."""
    out, size = [values], 1
    while 2 * size <= len(values):
        last = out[-1]
        out.append(take(last[:-size], last[size:]))
        size *= 2
    return out


def nearest_before(tables: list[np.ndarray], start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The last place before ``start`` with a value of ``least`` or more, -1 if there is none; ``tables`` of maxima."""
    at = start.copy()
    for level in range(len(tables)):  # over aligned runs, longer and longer, as long as they are too small
        step = 1 << level
        ok = (at & (2 * step - 1)) >= step
        ok[ok] = tables[level][at[ok] - step] < least[ok]
        at[ok] -= step
    for level in range(len(tables) - 1, -1, -1):
        step = 1 << level
        while True:
            ok = at >= step
            ok[ok] = tables[level][at[ok] - step] < least[ok]
            if not ok.any():
                break
            at[ok] -= step
    return at - 1


def two_best(counts: np.ndarray, lcp: np.ndarray, child: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and common starts of the best two parents of each ``child``; place -1 and start 0 where there is none.

    ``lcp[i]`` is the common start of elements ``i`` and ``i + 1`` in sorted order; a parent has a count of ``least`` or
    more.
    """
    maxima, minima = _tables(counts, np.maximum), _tables(lcp, np.minimum) if len(lcp) else []
    back = _tables(counts[::-1].copy(), np.maximum)
    n = len(counts)

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common start of elements ``a < b``: the smallest of the neighbours' between them."""
        out = np.zeros(len(a), np.int64)
        level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            out[some] = np.minimum(minima[k][a[some]], minima[k][b[some] - (1 << k)])
        return out

    places = np.full((4, len(child)), -1)
    starts = np.zeros((4, len(child)), np.int64)
    at = child
    for j in (0, 1):
        at = nearest_before(maxima, np.maximum(at, 0), least)
        ok = at >= 0
        places[j] = at
        starts[j, ok] = shared(at[ok], child[ok])
    at = n - 1 - child
    for j in (2, 3):
        at = nearest_before(back, np.maximum(at, 0), least)
        ok = at >= 0
        places[j, ok] = n - 1 - at[ok]
        starts[j, ok] = shared(child[ok], n - 1 - at[ok])
    starts[places < 0] = -1
    order = np.argsort(-starts, axis=0, kind="stable")[:2]
    places, starts = np.take_along_axis(places, order, 0), np.take_along_axis(starts, order, 0)
    return places, np.maximum(starts, 0)


_EDGE = ["part", "lead", "place", "n", "side", "sample", "seq_id", "key"]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outstanding elements at both borders of a range: of its first stretch towards the front, of its last to the end."""
    group: tuple | None = None
    parts: list[pa.RecordBatch] = []
    first = True
    schema = None

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        n = t.column("n").to_pylist()
        for lead in (True, False):
            if (lead and first) or (not lead and last):
                keep = outstanding(n, nearest_last=not lead)
                some = t.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [some.column("part"), pa.array([lead] * len(keep)), pa.array(range(len(keep)), pa.int32())]
                    + [some.column(c) for c in _EDGE[3:]],
                    names=_EDGE,
                )

    for b in batches:
        for s, e, key in _stretches(b):
            if key != group:
                if parts:
                    yield from close(last=False)
                    first = False
                group, parts = key, []
            parts.append(b.slice(s, e - s))
            if len(parts) > 50:  # what is outstanding at either border of the stretch so far is enough
                t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                n = t.column("n").to_pylist()
                keep = sorted({*outstanding(n, True), *outstanding(n, False)})
                parts = [t.take(pa.array(keep, pa.int64()))]
    if parts:
        yield from close(last=True)


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    """Rows of one range, side and sample."""
    part, side = b.column("part").to_numpy(), b.column("side").to_numpy()
    sample = b.column("sample").dictionary_encode()
    code = sample.indices.fill_null(-1).to_numpy()
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(side) != 0) | (np.diff(code) != 0)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        if e > s:
            yield s, e, (int(part[s]), int(side[s]), b.column("sample")[s].as_py())


def _search(fold: float, shared):
    """Best two parents of every child; rows of a range come in order, with its guests before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        parts: list[pa.RecordBatch] = []
        guests = shared.value if shared is not None else {}

        def close() -> pa.RecordBatch:
            own = pa.Table.from_batches([p.select(["seq_id", "n", "key", "kind"]) for p in parts])
            before, after = guests.get((*group, False)), guests.get((*group, True))
            around = [None if x is None else pa.Table.from_batches([x]).cast(own.schema) for x in (before, after)]
            own = pa.concat_tables([x for x in (around[0], own, around[1]) if x is not None])
            n = own.column("n").to_numpy()
            keys = own.column("key").to_pylist()
            lcp = np.fromiter((common_start(a, b) for a, b in zip(keys, keys[1:])), np.int64, max(0, len(keys) - 1))
            child = np.flatnonzero((own.column("kind").to_numpy() == 1) & (fold * n <= n.max(initial=0)))
            places, starts = two_best(n, lcp, child, np.ceil(fold * n[child] - 1e-9))
            some = starts[0] > 0
            child, places, starts = child[some], places[:, some], starts[:, some]
            ids = own.column("seq_id").combine_chunks()
            take = lambda x: ids.take(pa.array(np.maximum(x, 0), mask=x < 0))
            m = len(child)
            sample = parts[0].column("sample").slice(0, 1).take(pa.array(np.zeros(m, np.int64)))
            return pa.RecordBatch.from_arrays(
                [sample, take(child), pa.array(np.full(m, group[1], np.int32)), take(places[0]), pa.array(starts[0].astype(np.int32)),
                 take(places[1]), pa.array(starts[1].astype(np.int32))],
                names=["sample", "seq_id", "side", "p1", "k1", "p2", "k2"],
            )

        for b in batches:
            for s, e, key in _stretches(b):
                if key != group:
                    if parts:
                        yield close()
                    group, parts = key, []
                parts.append(b.slice(s, e - s))
        if parts:
            yield close()

    return run


def _wanted(meta: list) -> list[tuple[int, bool, int, int, int]]:
    """For each range and border the outstanding elements of the other ranges of its stretch: ``(part, after, ord, src, place)``.

    ``meta`` has ``(part, lead, place, n, side, sample)`` of the borders' elements, ``lead`` for those at the front.
    """
    ends: dict[tuple, dict[int, list]] = {}
    for r in sorted(meta, key=lambda r: (r["part"], r["place"])):
        ends.setdefault((r["side"], r["sample"]), {}).setdefault((r["part"], r["lead"]), []).append((r["n"], r["part"], r["place"]))
    out = []
    for by_part in ends.values():
        # the end of a range is before the first stretch of a later one, the front after the last stretch of an earlier one
        for after in (False, True):
            carried: list[tuple] = []
            for part in sorted({p for p, _ in by_part}, reverse=after):
                if (part, not after) in by_part:
                    out += [(part, after, i, p, at) for i, (_, p, at) in enumerate(carried)]
                if (part, after) in by_part:
                    own = by_part[part, after]
                    carried = own + carried if after else carried + own
                    carried = [carried[i] for i in outstanding([c[0] for c in carried], nearest_last=not after)]
    return out


def _among(fold: float, shared):
    """Best two parents of every child, looked up in the sorted parents of its sample, which all tasks have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple, tuple] = {}

        def table(sample, side: int) -> tuple:
            if (sample, side) not in tables:
                keys, ids, n = shared.value[sample, side]
                n = np.array(n, np.int64)
                tables[sample, side] = keys, ids, _tables(n, np.maximum), _tables(n[::-1].copy(), np.maximum)
            return tables[sample, side]

        for whole in batches:
            for b in (whole.slice(at, 5000) for at in range(0, whole.num_rows, 5000)):
                samples, texts = b.column(0).to_pylist(), b.column(3).to_pylist()
                rows: dict[object, list[int]] = {}
                for i, s in enumerate(samples):
                    if (s, 0) in shared.value:
                        rows.setdefault(s, []).append(i)
                for s, own in rows.items():
                    least = np.ceil(fold * b.column(2).to_numpy()[own] - 1e-9)
                    for side in (0, 1):
                        keys, ids, maxima, back = table(s, side)
                        mine = [texts[i][::-1] if side else texts[i] for i in own]
                        at = np.array([bisect_left(keys, k) for k in mine], np.int64)
                        found = []
                        left = at
                        for _ in range(2):
                            left = nearest_before(maxima, np.maximum(left, 0), least)
                            found.append(left)
                        right = len(keys) - at
                        for _ in range(2):
                            right = nearest_before(back, np.maximum(right, 0), least)
                            found.append(np.where(right < 0, -1, len(keys) - 1 - right))
                        places = np.stack(found)
                        starts = np.array([[common_start(k, keys[p]) if p >= 0 else -1 for k, p in zip(mine, row)] for row in places.tolist()])
                        order = np.argsort(-starts, axis=0, kind="stable")[:2]
                        places, starts = np.take_along_axis(places, order, 0), np.take_along_axis(starts, order, 0)
                        some = np.flatnonzero(starts[0] > 0)
                        if not len(some):
                            continue
                        at = pa.array(np.array(own)[some])
                        parents = pa.array(ids, b.column(1).type)
                        pick = lambda x: parents.take(pa.array(np.maximum(x, 0), mask=x < 0))
                        places, starts = places[:, some], np.maximum(starts[:, some], 0).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(some), side, np.int32)), pick(places[0]),
                             pa.array(starts[0]), pick(places[1]), pa.array(starts[1])],
                            names=["sample", "seq_id", "side", "p1", "k1", "p2", "k2"],
                        )

    return run


def best_parents(rows: DataFrame, fold: float) -> DataFrame:
    """``(sample, seq_id, side, p1, k1, p2, k2)`` of ``rows(sample, seq_id, n, seq)``: the two parents of the same sample, at least
    ``fold`` times as abundant, with the longest common start (``side`` 0) and end (1); ``p2`` is null if there is one only.

    Strings that are abundant enough for the rarest one of their sample are broadcast if their counted size allows it, so that
    no text is moved; else all strings are sorted. ``rows`` is a written table.
    """
    least = rows.groupBy("sample").agg(F.min("n").alias("low"))
    parents = attach(rows.select("sample", "seq_id", F.col("n").cast("long").alias("n"), "seq"), least, ["sample"]).where(
        F.col("n") >= fold * F.col("low")
    ).drop("low")
    size = parents.agg(F.sum(2 * F.octet_length("seq") + 256)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _sorted_parents(rows, fold)
    found: dict[tuple, list] = {}
    for r in parents.collect():  # bounded by the line above
        for side, key in enumerate((r["seq"], r["seq"][::-1])):
            found.setdefault((r["sample"], side), []).append((key, r["seq_id"], r["n"]))
    lists = {k: tuple(map(list, zip(*sorted(v, key=lambda x: x[0])))) for k, v in found.items()}
    shared = rows.sparkSession.sparkContext.broadcast(lists)
    plain = rows.select("sample", "seq_id", F.col("n").cast("long").alias("n"), "seq")
    return plain.mapInArrow(_among(fold, shared), _best_schema(rows))


def _best_schema(rows: DataFrame) -> T.StructType:
    kinds = {c: rows.schema[c].dataType for c in ("sample", "seq_id")}
    return T.StructType(
        [T.StructField("sample", kinds["sample"]), T.StructField("seq_id", kinds["seq_id"]), T.StructField("side", T.IntegerType())]
        + [T.StructField(c, t) for j in (1, 2) for c, t in ((f"p{j}", kinds["seq_id"]), (f"k{j}", T.IntegerType()))]
    )


def _sorted_parents(rows: DataFrame, fold: float) -> DataFrame:
    """``best_parents`` over the sorted order of all strings."""
    out = _best_schema(rows)
    spark = rows.sparkSession
    width = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    both = rows.select("sample", "seq_id", F.col("n").cast("long").alias("n"), F.posexplode(F.array("seq", F.reverse("seq"))).alias("side", "key"))
    laid = checkpointed(
        both.repartitionByRange(width, "side", "sample", "key").sortWithinPartitions("side", "sample", "key")
        .withColumn("part", F.spark_partition_id()).withColumn("kind", F.lit(1))
    )
    kinds = {c: laid.schema[c].dataType for c in laid.columns}
    edge = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("lead", T.BooleanType()), T.StructField("place", T.IntegerType())]
        + [T.StructField(c, kinds[c]) for c in _EDGE[3:]]
    )
    edges = checkpointed(laid.mapInArrow(_edges, edge))
    meta = edges.select("part", "lead", "place", "n", "side", "sample").collect()  # a few rows per range, without texts
    need = spark.createDataFrame(_wanted(meta), "part int, after boolean, ord int, src int, place int")
    source = edges.select(F.col("part").alias("src"), (~F.col("lead")).alias("tail"), "place", "side", "sample", "seq_id", "n", "key")
    guests = need.withColumn("tail", ~F.col("after")).join(source, ["src", "tail", "place"]).select(
        "part", "after", "ord", "side", "sample", "seq_id", "n", "key"
    )
    guests = checkpointed(guests)
    size = guests.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found: dict[tuple, pa.RecordBatch] = {}
        table = guests.orderBy("part", "after", "side", "sample", "ord").toArrow()
        if table.num_rows:
            keys = list(zip(*(table.column(c).to_pylist() for c in ("part", "side", "sample", "after"))))
            plain = table.select(["seq_id", "n", "key"]).append_column("kind", pa.array([0] * table.num_rows, pa.int32()))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                found[keys[s]] = plain.slice(s, e - s).combine_chunks().to_batches()[0]
        return laid.mapInArrow(_search(fold, spark.sparkContext.broadcast(found)), out)
    guests = guests.withColumn("kind", F.when(F.col("after"), F.lit(2)).otherwise(0))
    laid = laid.withColumn("ord", F.lit(0)).unionByName(guests.drop("after"))
    together = laid.repartition("part").sortWithinPartitions("part", "side", "sample", "kind", "ord", "key")
    return together.mapInArrow(_search(fold, None), out)


def bimera_flag(counts: DataFrame, seqs: DataFrame, fold: float = 2.0, dereplicate: bool = True) -> DataFrame:
    """Flag sequences that are an exact join of two more abundant parents of a sample, of any length.

    ``counts(seq_id, sample, n)``, ``seqs(seq_id, seq)``; ``fold`` over 1. ``prefix`` and ``suffix`` are the longest ones found
    in parents at least ``fold`` times as abundant. A sequence that is as a whole the start or the end of such a parent is a
    shorter read of it and no chimera. The two parts must come from two parents: if the best one is the same for both,
    the second best of either side decides. With ``dereplicate`` a flag holds only in its own sample.
    """
    rows = checkpointed(counts.join(seqs.select("seq_id", "seq"), "seq_id").select("sample", "seq_id", "n", "seq"))
    return flag_chimeras(rows, fold, dereplicate)


def flag_chimeras(rows: DataFrame, fold: float = 2.0, dereplicate: bool = True) -> DataFrame:
    """``bimera_flag`` of a written table ``rows(sample, seq_id, n, seq)``."""
    best = best_parents(rows, fold)
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = best.groupBy("sample", "seq_id").agg(*[side(c, s).alias(f"{c}_{s}") for c in ("p1", "k1", "p2", "k2") for s in (0, 1)])
    out = join_null_safe(rows.select("sample", "seq_id", F.length("seq").alias("len")), wide, ["sample", "seq_id"], "left")
    two = F.lit(False)
    for i in (1, 2):
        for j in (1, 2):
            a, b = F.col(f"k{i}_0"), F.col(f"k{j}_1")
            two = two | F.coalesce((a > 0) & (b > 0) & (a + b >= F.col("len")) & (F.col(f"p{i}_0") != F.col(f"p{j}_1")), F.lit(False))
    prefix, suffix = F.coalesce("k1_0", F.lit(0)), F.coalesce("k1_1", F.lit(0))
    out = out.select(
        "sample", "seq_id", prefix.alias("prefix"), suffix.alias("suffix"),
        (two & (F.greatest(prefix, suffix) < F.col("len"))).alias("chimera"),
    )
    if dereplicate:
        return out
    anywhere = out.where("chimera").select("seq_id").distinct().withColumn("_hit", F.lit(True))
    return out.join(anywhere, "seq_id", "left").withColumn("chimera", F.coalesce("_hit", F.lit(False))).drop("_hit")
