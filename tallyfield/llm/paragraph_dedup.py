"""Substring dedup: MinHash bands over paragraphs, exact Jaccard on colliding ones, components of removals.

A paragraph is a line of at least ``min_words`` words, or a run of shorter lines, up to a blank or a long one, that has
so many together, as in text wrapped by line breaks. Words are lower-cased and split at white space, so the same
words wrapped otherwise are the same paragraph. Equal word sequences collapse to one before banding: thousands of
copies are one row from there on.

What stays is searched for passages of ``span`` words or more that repeat word by word, in each document's whole word
sequence, line breaks being white space. Runs of ``SEED`` words are picked by the smallest hash in a window, which falls on
the same words in every copy of a passage; around the picked runs that occur again all windows of ``span`` words
are grouped, and those that repeat are joined to word spans.

Texts are cut into words once for all documents; again for those that hold a colliding paragraph, and for those that
hold a picked run of another place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.seqs import connected_components
from .common import BROADCAST_BYTES, byte_slices, checkpointed, join_hot, small_batches, strings

SHINGLE = 5
MIN_WORDS = 50
THRESHOLD = 0.8
#: Bytes of shingle sets of a band bucket that one task compares; larger ones go as pairs of blocks of half that size.
BLOCK_BYTES = 8 << 20
#: Words of the shortest repeated passage, and of the runs picked to find it.
SPAN = 50
SEED = 16
#: Distinct words whose hash a worker remembers.
CACHE = 300_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    count: int
    rows: int


def tune_bands(threshold: float = THRESHOLD, recall: float = 0.9999, hashes: int = 40) -> Bands:
    """The most selective banding of at most ``hashes`` hashes that finds a pair at ``threshold`` with ``recall``.

    With more rows a band is more selective but more bands are needed; the fewest that reach the recall are taken.
    """
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            return Bands(bands, rows)
    raise ValueError("no banding reaches that recall")


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


_HASH = _WordHash()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _GOLDEN + b * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every ``n`` consecutive word hashes, put together from runs of doubled length."""
    if len(h) < n:
        return h[:0]
    out, done, part, size = None, 0, h, 1
    while True:
        if n & size:
            m = len(h) - done - size + 1
            out = part[:m] if out is None else _mix(out[:m], part[done : done + m])
            done += size
        if done == n:
            return out
        part, size = _mix(part[:-size], part[size:]), 2 * size


def _slide(x: np.ndarray, window: int, take) -> np.ndarray:
    """``take`` (smallest or largest) of every ``window`` consecutive values, in log steps."""
    size = 1
    while 2 * size <= window:
        x, size = take(x[:-size], x[size:]), 2 * size
    return take(x[: len(x) - (window - size)], x[window - size :]) if window > size else x


def picked(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in every ``window`` consecutive ones, all places of equal ones."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    low = _slide(h, window, np.minimum)
    # the largest of the minima of all windows over a place; before the first and after the last there is none
    over = _slide(np.concatenate([np.zeros(window - 1, h.dtype), low, np.zeros(window - 1, h.dtype)]), window, np.maximum)
    return np.flatnonzero(over == h)


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + sizes[i] - 1`` of all ``i`` in order."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Words:
    """The words of some texts as hashes, with the first word of every text and line."""

    def __init__(self, texts: list[str]):
        flat: list[str] = []
        lines, of_text = [0], [0]
        for t in texts:
            for line in t.lower().split("\n"):
                flat += line.split()
                lines.append(len(flat))
            of_text.append(len(lines) - 1)
        self.hash = np.fromiter(map(_HASH.__getitem__, flat), np.uint64, len(flat))
        self.line = np.array(lines, np.int64)
        self.first_line = np.array(of_text, np.int64)
        self.text = self.line[self.first_line]

    def paragraphs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and size of every paragraph of ``least`` words or more."""
        sizes = np.diff(self.line)
        short = (sizes > 0) & (sizes < least)
        new = np.ones(len(sizes), bool)
        new[1:] = ~(short[1:] & short[:-1])
        new[self.first_line[:-1]] = True
        at = np.flatnonzero(new)
        start, size = self.line[at], np.diff(np.append(self.line[at], self.line[-1]))
        own = np.searchsorted(self.first_line, at, "right") - 1
        some = (size >= least) & (size > 0)
        return own[some], start[some], size[some]

    def sets(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word shingles of paragraphs, repeats included, and how many each has; a shorter one has one."""
        every = run_hashes(np.append(self.hash, np.zeros(SHINGLE - 1, np.uint64)), SHINGLE)
        few = np.minimum(size, SHINGLE)
        for i in np.flatnonzero(size < SHINGLE):  # its words, then zeros
            own = np.zeros(SHINGLE, np.uint64)
            own[: size[i]] = self.hash[start[i] : start[i] + size[i]]
            every[start[i]] = run_hashes(own, SHINGLE)[0]
        n = size - few + 1
        return every[_within(start, n)], n


def digests(sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each paragraph's word sequence, from its shingles and their places in it."""
    if not len(n):
        return np.zeros(0, np.uint64)
    place = _within(np.zeros(len(n), np.int64), n).astype(np.uint64)
    return np.add.reduceat(_mix(sh, place), np.cumsum(n) - n)


def band_keys(sh: np.ndarray, n: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit key per paragraph and band over the minima of multiply-and-mix hashes of the shingles."""
    rng = np.random.default_rng(11)
    mul = rng.integers(1, 1 << 63, bands.count * bands.rows, np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, bands.count * bands.rows, np.uint64)
    keys = np.tile(np.arange(bands.count, dtype=np.uint64), (len(n), 1))
    if not len(n):
        return keys
    first = np.cumsum(n) - n
    for band in range(bands.count):
        for r in range(band * bands.rows, (band + 1) * bands.rows):
            x = sh * mul[r]
            x += add[r]
            x ^= x >> np.uint64(32)
            key = (keys[:, band] ^ np.minimum.reduceat(x, first)) * np.uint64(0xC2B2AE3D27D4EB4F)
            keys[:, band] = key ^ (key >> np.uint64(31))
    return keys


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _scan(min_words: int, span: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            words = Words(strings(b.column("text")))
            n = b.num_rows
            own, start, size = words.paragraphs(min_words)
            sh, many = words.sets(start, size)
            per = np.bincount(own, minlength=n)
            at, seed = words_seeds(words, span)
            text = np.searchsorted(words.text, at, "right") - 1
            seeds = np.bincount(text, minlength=n)
            lines = np.diff(words.first_line)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), _lists((start - words.text[own]).astype(np.int32), per), _lists(size.astype(np.int32), per),
                    _lists(digests(sh, many).view(np.int64), per), _lists(band_keys(sh, many, bands).view(np.int64).ravel(), per * bands.count),
                    _lists((at - words.text[text]).astype(np.int32), seeds), _lists(seed.view(np.int64), seeds),
                    _lists((words.line[:-1] - np.repeat(words.text[:-1], lines)).astype(np.int32), lines),
                ],
                names=[x.split()[0] for x in SCAN.split(", ")],
            )

    return run


SCAN = (
    "doc_id long, first array<int>, size array<int>, para array<long>, keys array<long>, at array<int>, seed array<long>, "
    "lines array<int>"
)


def words_seeds(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the picked runs; every window of ``span`` words inside a text holds one."""
    h = run_hashes(words.hash, SEED)
    at = picked(h, span - SEED + 1)
    text = np.searchsorted(words.text, at, "right") - 1
    inside = (at + SEED <= words.text[text + 1]) & (np.diff(words.text)[text] >= span)
    return at[inside], h[at[inside]]


def scan(docs: DataFrame, id_col: str, text_col: str, min_words: int, span: int, bands: Bands) -> DataFrame:
    """A row per document: its paragraphs (first word, size, digest of the words, band keys), picked runs and lines."""
    with small_batches(docs.sparkSession):
        return checkpointed(_plain(docs, id_col, text_col).mapInArrow(_scan(min_words, span, bands), SCAN))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _broadcast_if_small(df: DataFrame, per_list: str | None = None) -> DataFrame:
    """A written table, hinted for a broadcast if its counted rows and list entries stay under the size bound."""
    rows, entries = _sizes(df, per_list)
    return F.broadcast(df) if 64 * (rows + entries) <= BROADCAST_BYTES else df


def _sizes(df: DataFrame, per_list: str | None) -> tuple[int, int]:
    row = df.agg(F.count("*"), F.sum(F.size(per_list)) if per_list else F.lit(0)).first()
    return row[0], row[1] or 0


def _with_texts(docs: DataFrame, lists: DataFrame, per_list: str) -> DataFrame:
    """The texts of the documents in ``lists``, a written table with a row per document, joined to its columns.

    Lists, or else the ids alone, are broadcast if they are small, so that other texts are not moved.
    """
    rows, entries = _sizes(lists, per_list)
    if 64 * (rows + entries) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(lists), "doc_id")
    if 32 * rows <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(lists.select("doc_id")), "doc_id", "left_semi")
    return docs.join(lists, "doc_id")


def shingle_table(docs: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """``(para, shingles)`` of the paragraphs whose place ``(doc_id, para)`` is in ``places``; ``docs`` as of ``_plain``.

    Texts are shuffled only where the places are too many to be broadcast.
    """
    wanted = checkpointed(places.groupBy("doc_id").agg(F.collect_list("para").alias("paras")))  # paragraphs of one document
    both = _with_texts(docs, wanted, "paras")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            words = Words(strings(b.column("text")))
            own, start, size = words.paragraphs(min_words)
            sh, many = words.sets(start, size)
            found, names = [], []
            ends = np.cumsum(many)
            left = [set(x) for x in b.column("paras").to_pylist()]
            for text, para, s, e in zip(own.tolist(), digests(sh, many).view(np.int64).tolist(), (ends - many).tolist(), ends.tolist()):
                if para in left[text]:
                    left[text].discard(para)
                    names.append(para)
                    found.append(np.unique(sh[s:e]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], names=["para", "shingles"])

    return both.select("text", "paras").mapInArrow(run, "para long, shingles binary").dropDuplicates(["para"])


def links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs with Jaccard similarity of at least ``threshold``.

    Breadth first: a member meets the unreached ones only, through postings of shared shingles, so a dense
    group costs a few passes and no pair is listed.
    """
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both / (len(sets[0]) + len(sets[1]) - both) >= threshold else []
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    by_code = np.argsort(codes, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    posting = owner[by_code]
    fresh = np.ones(n, bool)
    out, live = [], n
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        live -= 1
        front = [root]
        while front and live:
            a = front.pop()
            mine = codes[starts[a] : starts[a + 1]]
            meet = np.concatenate([posting[first[c] : first[c + 1]] for c in mine])
            both = np.bincount(meet[fresh[meet]], minlength=n)
            new = np.flatnonzero(both / (sizes[a] + sizes - both) >= threshold)
            fresh[new] = False
            live -= len(new)
            out += [(a, int(x)) for x in new]
            front += new.tolist()
            if live < len(posting) // 64:  # drop reached members from the postings now and then
                keep = fresh[posting]
                first = np.concatenate([[0], np.cumsum(keep)])[first]
                posting = posting[keep]
    return out


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, paras, sets = None, [], []

        def close():
            if len(paras) < 2:
                return [], []
            found = links(sets, threshold)
            return [paras[a] for a, _ in found], [paras[b] for _, b in found]

        for b in batches:
            out: tuple[list, list] = ([], [])
            for k, para, sh in zip(b.column("key").to_pylist(), b.column("para").to_pylist(), b.column("shingles").to_pylist()):
                if k != key:
                    for o, x in zip(out, close()):
                        o += x
                    key, paras, sets = k, [], []
                paras.append(para)
                sets.append(np.frombuffer(sh, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in close()], names=["a", "b"])

    return run


def _paragraph_repeats(docs: DataFrame, scanned: DataFrame, min_words: int, threshold: float, within: bool) -> DataFrame:
    """``(doc_id, first_word, n_words, component_id, kept_doc_id, kept_first_word)`` of all paragraphs with a like one."""
    places = scanned.select("doc_id", F.inline(F.arrays_zip("first", "size", "para")))
    count = F.size("para")
    keyed = scanned.where(count > 0).select(
        "doc_id", F.posexplode("para").alias("k", "para"), "first", "size", "keys", (F.size("keys") / count).cast("int").alias("bands")
    ).select("doc_id", "para", F.col("first")[F.col("k")].alias("first"), F.col("size")[F.col("k")].alias("size"),
             F.expr("slice(keys, k * bands + 1, bands)").alias("keys"))
    # one row per word sequence, with its first place and number of occurrences
    rows = checkpointed(keyed.groupBy("para").agg(
        F.min(F.struct("doc_id", "first")).alias("place"), F.max("doc_id").alias("last"), F.count("*").alias("n"),
        F.first("size").alias("size"), F.first("keys").alias("keys"),
    ))
    banded = rows.select("para", "size", F.explode("keys").alias("band"))
    # buckets of the same members, as bands of a few near copies are, are one; sums of hashes name the set
    same = [F.sum(F.xxhash64("para").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("para", F.lit(1))).alias("xor")]
    shared = banded.groupBy("band").agg(F.count("*").alias("members"), F.sum("size").alias("words"), *same).where("members > 1")
    shared = checkpointed(shared.groupBy("members", "words", "sum", "xor").agg(F.min("band").alias("band")).drop("sum", "xor"))
    hits = checkpointed(banded.drop("size").join(_broadcast_if_small(shared), "band"))
    first = rows.select("para", F.col("place.doc_id").alias("doc_id")).join(hits.select("para").distinct(), "para")
    table = shingle_table(docs, first, min_words)
    # a bucket over BLOCK_BYTES is dealt to blocks, and every pair of blocks is compared by a task of its own
    half = BLOCK_BYTES // 2
    blocks = F.when(8 * F.col("words") > BLOCK_BYTES, F.ceil(8 * F.col("words") / half)).otherwise(1).cast("int")
    dealt = hits.withColumn("blocks", F.least(blocks, F.col("members").cast("int")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("para", "band"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR other <> own")
    key = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    group = dealt.select("para", key.alias("key")).join(table, "para")
    pairs = checkpointed(
        group.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(threshold), "a long, b long").distinct()
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("seq_id")).distinct()
    joined = connected_components(ends, pairs).select(F.col("seq_id").alias("para"), "cluster")
    member = rows.join(joined, "para", "left").where("n > 1 OR cluster IS NOT NULL").select(
        "para", "place", "last", "n", F.coalesce("cluster", "para").alias("component_id")
    )
    kept = member.groupBy("component_id").agg(F.min("place").alias("kept"), F.max("last").alias("last"))
    kept = (kept if within else kept.where("last <> kept.doc_id")).drop("last")
    named = checkpointed(member.join(kept, "component_id").select("para", "n", "component_id", "kept"))
    return join_hot(places, named, "para", "n").select(
        "doc_id", F.col("first").alias("first_word"), F.col("size").alias("n_words"), "component_id",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.first").alias("kept_first_word"),
    )


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            words = Words(strings(b.column("text")))
            h = run_hashes(words.hash, span)
            places, own = [], []
            begin, end = words.text[:-1], words.text[1:]
            for i, (seeds, gone) in enumerate(zip(b.column("seeds").to_pylist(), b.column("gone").to_pylist())):
                n = int(end[i] - begin[i])
                at = np.unique(np.array(seeds, np.int64)[:, None] - np.arange(span - SEED + 1))
                at = at[(at >= 0) & (at + span <= n)]
                if gone:
                    cover = np.zeros(n + 1, np.int64)
                    for g in gone:
                        cover[g["first_word"] + 1 : g["first_word"] + g["n_words"] + 1] = 1
                    cover = np.cumsum(cover)
                    at = at[cover[at + span] == cover[at]]
                places.append(at)
                own.append(begin[i] + at)
            flat = np.concatenate(places) if places else np.zeros(0, np.int64)
            docs = np.repeat(b.column("doc_id").to_numpy(), [len(p) for p in places])
            hashes = h[np.concatenate(own)] if len(flat) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(flat.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["doc_id", "at", "win"]
            )

    return run


def spans(at: np.ndarray, first_doc: np.ndarray, first_at: np.ndarray, own: np.ndarray, span: int) -> list[tuple]:
    """``(first_word, n_words, kept_doc, kept_word, removed)`` of one document from its repeated windows, by place.

    A word goes if a window that repeats an earlier one has it and no window that is the first of its kind does; so
    the first occurrence of every repeated passage stays whole. Neighbouring words that go are one span, whatever
    they repeat; its kept place is that of its first word.
    """
    n = int(at[-1]) + span

    def covered(some: np.ndarray) -> np.ndarray:
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, at[some], 1)
        np.add.at(steps, at[some] + span, -1)
        return np.cumsum(steps[:n]) > 0

    def runs(mask: np.ndarray) -> list[list[int]]:
        return np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2).tolist()

    keep = covered(own)
    out = [(s, e - s, None, None, False) for s, e in runs(keep)]
    later = np.flatnonzero(~own)
    for s, e in runs(covered(~own) & ~keep):
        k = later[max(0, int(np.searchsorted(at[later], s, "right")) - 1)]
        out.append((s, e - s, int(first_doc[k]), int(first_at[k] - at[k] + s), True))
    return out


def _join_spans(span: int):
    names = ["doc_id", "first_word", "n_words", "kept_doc_id", "kept_first_word", "removed"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        parts: list[list[np.ndarray]] = []

        def close() -> list[tuple]:
            if current is None:
                return []
            at, fd, fa = (np.concatenate(x) for x in zip(*parts))
            at, some = np.unique(at, return_index=True)
            fd, fa = fd[some], fa[some]
            found = spans(at.astype(np.int64), fd, fa, (fd == current) & (fa == at), span)
            return [(current, s, n, current if kd is None else kd, s if ka is None else ka, gone) for s, n, kd, ka, gone in found]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for b in batches:
            doc, at, fd, fa = (b.column(c).to_numpy() for c in ("doc_id", "at", "first_doc", "first_at"))
            rows = []
            change = np.flatnonzero(np.diff(doc)) + 1
            for s, e in zip([0, *change], [*change, len(doc)]):
                if s == e:
                    continue
                if int(doc[s]) != current:
                    rows += close()
                    current, parts = int(doc[s]), []
                parts.append([at[s:e], fd[s:e], fa[s:e]])
            yield batch(rows)
        yield batch(close())

    return run


def _span_repeats(docs: DataFrame, scanned: DataFrame, removed: DataFrame, span: int, within: bool) -> DataFrame:
    """Repeated passages of at least ``span`` words outside of the paragraphs ``removed(doc_id, first_word, n_words)``.

    Every repeated window of ``span`` words is found, as it holds a picked run at the same place as its copies.
    """
    gone = checkpointed(  # paragraphs of one document
        removed.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "n_words")).alias("gone"))
    )
    runs = scanned.select("doc_id", F.arrays_zip("at", "seed").alias("runs")).where(F.size("runs") > 0)
    meets = lambda r, g: (r["at"] < g["first_word"] + g["n_words"]) & (r["at"] + SEED > g["first_word"])
    left = F.filter("runs", lambda r: ~F.exists("gone", lambda g: meets(r, g)))
    seeds = runs.join(_broadcast_if_small(gone, "gone"), "doc_id", "left").select(
        "doc_id", F.inline(F.when(F.col("gone").isNull(), F.col("runs")).otherwise(left))
    )
    seeds = checkpointed(seeds)
    again = checkpointed(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"))
    hits = join_hot(seeds, again, "seed", "n").groupBy("doc_id").agg(F.collect_set("at").alias("seeds"))
    hits = checkpointed(hits.join(gone, "doc_id", "left"))
    both = _with_texts(docs, hits, "seeds").select("doc_id", "text", "seeds", "gone")
    with small_batches(docs.sparkSession):
        windows = checkpointed(both.mapInArrow(_windows(span), "doc_id long, at int, win long"))
    place = F.struct(F.col("doc_id").alias("first_doc"), F.col("at").alias("first_at"))
    firsts = windows.groupBy("win").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    firsts = checkpointed(firsts.where("first <> last" if within else "first.first_doc <> last.first_doc").select("win", "first.*", "n"))
    marked = join_hot(windows, firsts, "win", "n").select("doc_id", "at", "first_doc", "first_at")
    return marked.repartition("doc_id").sortWithinPartitions("doc_id", "at").mapInArrow(
        _join_spans(span), "doc_id long, first_word int, n_words int, kept_doc_id long, kept_first_word int, removed boolean"
    )


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                 threshold: float = THRESHOLD, recall: float = 0.9999, span: int = SPAN, within: bool = False) -> DataFrame:
    """Every paragraph that occurs again, equal or similar, and every passage that occurs again in what stays.

    ``(doc_id, paragraph, first_word, n_words, component_id, kept_doc_id, kept_first_word, removed)``: words are numbered
    from 0 in the whole document, ``paragraph`` is the line that holds the first one. For paragraphs,
    ``component_id`` is the digest of the component's smallest member; the first occurrence by (doc_id, first_word) of a
    component is kept, all others are removed. In what stays, words in passages of at least ``span`` words that
    occur earlier by (doc_id, word) are removed, except those in the first occurrence of another one;
    ``component_id`` is then a hash of the kept place. Neighbouring words that go are one row. The kept places have rows,
    too, with ``removed`` false: they are finds as well, and lie wholly in repeated passages. What repeats inside one
    document alone is left as it is, unless ``within`` is set.

    Null text has no paragraph; rows without an id are left out, as they can't be named. Repeated rows repeat the
    same place and are kept or removed with it; a passage inside them is given once. Rows of one id and other texts
    are taken for one document.
    """
    if span < SEED:
        raise ValueError(f"span must be at least {SEED}")
    scanned = scan(docs, id_col, text_col, min_words, span, tune_bands(threshold, recall))
    plain = _plain(docs, id_col, text_col)
    paragraphs = checkpointed(
        _paragraph_repeats(plain, scanned, min_words, threshold, within).withColumn(
            "removed", (F.col("doc_id") != F.col("kept_doc_id")) | (F.col("first_word") != F.col("kept_first_word"))
        )
    )
    inside = _span_repeats(plain, scanned, paragraphs.where("removed").select("doc_id", "first_word", "n_words"), span, within)
    found = paragraphs.unionByName(inside.withColumn("component_id", F.xxhash64("kept_doc_id", "kept_first_word")))
    lines = scanned.groupBy("doc_id").agg(F.min("lines").alias("lines"))
    line = F.size(F.filter("lines", lambda x: x <= F.col("first_word"))) - 1
    return found.join(lines, "doc_id").select(
        "doc_id", line.alias("paragraph"), "first_word", "n_words", "component_id", "kept_doc_id", "kept_first_word", "removed"
    )


def _without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words in ``gone`` (first word, number) and without the lines that lose all of theirs."""
    lines, at = [], 0
    cut = np.zeros(max(first + n for first, n in gone) + 1, bool)
    for first, n in gone:
        cut[first : first + n] = True
    for line in text.split("\n"):
        words = list(re.finditer(r"\S+", line))
        away = cut[at : at + len(words)]
        at += len(words)
        if away.any():
            if len(away) == len(words) and away.all():
                continue
            ends = [w.start() for w in words[1:]] + [len(line)]
            away = away.tolist() + [False] * (len(words) - len(away))
            line = line[: words[0].start()] + "".join(line[w.start() : e] for w, e, x in zip(words, ends, away) if not x)
        lines.append(line)
    return "\n".join(lines)


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, without the words marked ``removed`` and the lines left empty; every row stays."""
    span = F.struct("first_word", "n_words")
    gone = repeats.where("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(span).alias("__gone"))
    joined = docs.join(gone, F.col(id_col) == F.col("__id"), "left").select(*docs.columns, "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            for i, cuts in enumerate(b.column("__gone").to_pylist()):
                if cuts and texts[i] is not None:
                    texts[i] = _without(texts[i], [(c["first_word"], c["n_words"]) for c in cuts])
            done = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield done.select(docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(run, docs.schema)
