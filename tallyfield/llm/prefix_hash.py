"""Document fingerprints by prefix polynomial hashes.

``S[i] = sum_{j<i} c_j B**j mod p`` for two primes. ``S[b] - S[a]`` scaled by a power of ``B`` compares any two spans in
constant time; binary search over span lengths gives the longest common extension of two places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Two primes below 2**31, so that products of a code point and a power fit 63 bits, and their bases.
PRIMES = (2_147_483_629, 2_147_483_587)
BASES = (1_000_003, 998_244_353)


class Powers:
    """``B**i`` for both primes, grown on demand."""

    def __init__(self):
        self.rows = [np.ones(1, np.int64), np.ones(1, np.int64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.rows[0]) <= n:
            for k, p in enumerate(PRIMES):
                row = self.rows[k]
                self.rows[k] = np.concatenate([row, row * (int(row[-1]) * BASES[k] % p) % p])
        return self.rows


POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """Prefix arrays of a text; both have one entry more than the text has code points."""

    def __init__(self, text: str):
        points = code_points(text).astype(np.int64) + 1
        self.n = len(points)
        powers = POWERS.upto(self.n + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            out = np.zeros(self.n + 1, np.int64)
            for at in range(0, self.n, 1 << 20):  # sums of 2**20 residues stay far below 2**63
                part = points[at : at + (1 << 20)]
                part = part * powers[k][at : at + len(part)] % p
                np.cumsum(part, out=part)
                out[at + 1 : at + 1 + len(part)] = (part + out[at]) % p
            self.sums.append(out)

    def span(self, start: int, size: int) -> tuple[int, int]:
        """Hashes of ``size`` code points from ``start``, times ``B**start``."""
        return tuple(int((s[start + size] - s[start]) % p) for s, p in zip(self.sums, PRIMES))

    def same(self, start: int, other: "PrefixHash", at: int, size: int) -> bool:
        """Whether both spans are equal."""
        mine, its = self.span(start, size), other.span(at, size)
        return all(
            mine[k] * int(POWERS.rows[k][at]) % p == its[k] * int(POWERS.rows[k][start]) % p for k, p in enumerate(PRIMES)
        )

    def extension(self, start: int, other: "PrefixHash", at: int) -> int:
        """Length of the longest common extension from two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def back_extension(self, other: "PrefixHash") -> int:
        """Length of the longest common ending."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(self.n - middle, other, other.n - middle, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def replaced_end(self, kept: int, other: "PrefixHash", taken: int) -> "PrefixHash":
        """The first ``kept`` code points followed by the first ``taken`` of ``other``, from the two arrays alone."""
        out = object.__new__(PrefixHash)
        out.n = kept + taken
        rows = POWERS.upto(out.n + 1)
        out.sums = [
            np.concatenate([mine[: kept + 1], (mine[kept] + its[1 : taken + 1] * int(rows[k][kept]) % p) % p])
            for k, (p, mine, its) in enumerate(zip(PRIMES, self.sums, other.sums))
        ]
        return out

    def fingerprint(self) -> str:
        """Length and both hashes of the whole, as hex."""
        return f"{self.n:08x}{int(self.sums[0][-1]):08x}{int(self.sums[1][-1]):08x}"


def likeness(a: PrefixHash, b: PrefixHash) -> float:
    """Share of the longer text that lies in the common beginning and ending; 1 for equal texts, empty ones too."""
    longest = max(a.n, b.n)
    if not longest:
        return 1.0
    head = a.extension(0, b, 0)
    if head == longest:
        return 1.0
    return (head + min(a.back_extension(b), min(a.n, b.n) - head)) / longest


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to ranges of descending id, each range closed by a copy of the row that follows it.

    ``(bucket, look, key, doc_id, text)``: ``look`` marks the copy. Cut points and the largest id of each range,
    a few numbers per partition, come to the driver; texts are shuffled once. A null id comes last.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    edges = F.lit(sorted(set(cuts), reverse=True)).cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda e: e > F.col("key")))
    heads = sorted(
        (r["bucket"], r["head"]) for r in rows.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("head")).collect()
    )  # a row per range
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("look"), "key", "doc_id", "text")
    ids = F.lit([h for _, h in heads]).cast("array<bigint>")
    before = F.lit([heads[k - 1][0] for k in range(len(heads))]).cast("array<int>")
    at = F.array_position(ids, F.col("key")).cast("int")
    copy = F.when(at > 0, F.struct(F.get(before, at - 1).alias("bucket"), F.lit(1).alias("look")))
    places = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("look")), copy))
    return rows.select(F.inline(places), "key", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "look", F.desc("key"), "text"
    )


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text replaces the last third of the code points by the first as many of the next document in
    descending id (after the last, the first), or by all of it. Returns ``(doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next)``. Null text counts as empty. Rows with the same id
    follow by text; a single row is its own next. The edited hashes come from the two prefix arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # bucket, doc_id, text, hashes
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out = []
            for bucket, look, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "look", "doc_id", "text"))):
                if look and (pending is None or pending[0] != bucket):
                    continue  # a further row of the id that follows
                own = PrefixHash(text)
                if pending is not None and pending[0] == bucket:
                    _, name, before, mine = pending
                    end = mine.n // 3
                    taken = min(end, own.n)
                    edited = mine.replaced_end(mine.n - end, own, taken)
                    plain = before[: mine.n - end] + text[:taken]
                    out.append((
                        name, mine.n, hashlib.sha256(plain.encode("utf-8", "replace")).hexdigest(), mine.fingerprint(),
                        edited.fingerprint(), likeness(mine, edited), likeness(mine, own),
                    ))
                pending = None if look else (bucket, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
