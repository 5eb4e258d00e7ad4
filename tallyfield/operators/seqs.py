"""Operators on collections of sequences (any strings): screening, dereplication, classification,
distances, clusters and chimera flags. Work is done on distinct sequences with their counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import BROADCAST_BYTES, broadcast_if_small, checkpointed
from .blocking import near_pairs
from .chimera import bimera_flag, flag_chimeras
from .ranks import quantiles
from .words import class_sums

# ---------------------------------------------------------------- measures and screening


def sequence_features(df: DataFrame, seq: str, alphabet: str = "ACGT", gaps: str = r"\.\-") -> DataFrame:
    x = F.col(seq)
    return df.withColumns(
        {
            "length": F.length(x),
            "ambig": S.ambiguous(x, alphabet),
            "homopolymer": S.longest_run(x),
            "first_base": S.first_base(x, gaps),
            "last_base": S.last_base(x, gaps),
        }
    )


def screen(
    features: DataFrame,
    max_ambig: int | None = None,
    min_length: int | None = None,
    max_length: int | None = None,
    max_homop: int | None = None,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Keep sequences inside every given bound; aligned ones must start and end outside the window."""
    rules = [
        (max_ambig, lambda v: F.col("ambig") <= v), (min_length, lambda v: F.col("length") >= v),
        (max_length, lambda v: F.col("length") <= v), (max_homop, lambda v: F.col("homopolymer") <= v),
        (start, lambda v: F.col("first_base") <= v), (end, lambda v: F.col("last_base") >= v),
    ]
    out = features
    for value, rule in rules:
        if value is not None:
            out = out.where(rule(value))
    return out


def feature_summary(features: DataFrame, names: Sequence[str], freq: str) -> DataFrame:
    """Weighted minimum, quantiles, maximum and mean of each measure."""
    long = features.unpivot([freq], list(names), "feature", "v").groupBy("feature", "v").agg(
        F.sum(freq).alias("w")
    )
    q = quantiles(
        long, ["feature"], "v", {"q025": 0.025, "q250": 0.25, "median": 0.5, "q750": 0.75, "q975": 0.975}, weight="w"
    )
    rest = long.groupBy("feature").agg(
        F.min("v").cast("double").alias("minimum"), F.max("v").cast("double").alias("maximum"),
        (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"),
    )
    return q.join(rest, "feature")


def weighted_error_rate(
    df: DataFrame, errors: str, sequences: str, length: int = 250, by: Sequence[str] = ()
) -> DataFrame:
    """Errors per base over a histogram of (errors, sequences)."""
    rate = F.sum(F.col(errors) * F.col(sequences)) / (F.sum(sequences) * length)
    return df.groupBy(*by).agg(rate.alias("rate"))


def dereplicate(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences and their counts per sample from ``(seq_id, sample, seq)``.

    Returns ``(unique(rep, key, n), counts(rep, sample, n))``. Only the digest of the text is
    shuffled, and copies collapse map-side before it.
    """
    per = reads.groupBy(F.sha2("seq", 256).alias("key"), "sample").agg(
        F.min("seq_id").alias("first"), F.count("*").alias("n")
    )
    unique = per.groupBy("key").agg(F.min("first").alias("rep"), F.sum("n").alias("n"))
    counts = per.select("key", "sample", "n").join(unique.select("key", "rep"), "key").select("rep", "sample", "n")
    return unique, counts


def feature_table(counts: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Reads per (sample, otu) from sequence counts and the cluster list."""
    return counts.join(clusters, key).groupBy("sample", "otu").agg(F.sum("n").alias("reads"))


# ---------------------------------------------------------------- reads


#: Pairs whose overlaps are sought together; they are of similar length.
_PAIRS = 1024


def _bit_planes(texts: list[str], numbers: dict[str, int], width: int, right: bool) -> np.ndarray:
    """The characters' numbers as bits: planes x texts x 64-bit words, padded to ``width`` characters on one side."""
    codes = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        own = np.fromiter(map(numbers.__getitem__, t), np.uint32, len(t))
        codes[i, width - len(t) :] = own if right else 0
        if not right:
            codes[i, : len(t)] = own
    planes = max(1, (len(numbers) - 1).bit_length())
    bits = ((codes[None] >> np.arange(planes, dtype=np.uint32)[:, None, None]) & 1).astype(np.uint8)
    packed = np.packbits(bits, axis=2, bitorder="little")
    whole = np.zeros((*packed.shape[:2], 8 * (-(-width // 64) + 1)), np.uint8)  # a word of zeros behind
    whole[:, :, : packed.shape[2]] = packed
    return whole.view("<u8")


def overlaps(fwd: list[str], rev: list[str], min_overlap: int, max_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Length and mismatches of each pair's best gap-free overlap; 0 where no one is within ``max_share``.

    Characters are bits in planes, two for four bases. For each length of the overlap the ends of all first strings are
    shifted over the starts of all second ones; the planes' differences, put together by OR, are counted by bits.
    """
    numbers = {c: i for i, c in enumerate(sorted(set("".join(fwd)) | set("".join(rev))))}
    sizes = np.minimum([len(t) for t in fwd], [len(t) for t in rev])
    top, width = int(sizes.max(initial=0)), max(map(len, fwd), default=0)
    x, y = _bit_planes(fwd, numbers, width, True), _bit_planes(rev, numbers, max(map(len, rev), default=0), False)
    best, bad = np.zeros(len(fwd), np.int32), np.zeros(len(fwd), np.int32)
    share = np.full(len(fwd), np.nextafter(max_share, 2.0))
    for o in range(top, min_overlap - 1, -1):
        live = np.flatnonzero((sizes >= o) & (share > 0))
        if not len(live):
            continue
        word, bit, n = (width - o) // 64, np.uint64((width - o) % 64), -(-o // 64)
        part = x[:, live, word : word + n + 1]
        shifted = part[..., :n] >> bit
        if bit:
            more = part[..., 1 : n + 1] << (np.uint64(64) - bit)
            shifted[..., : more.shape[-1]] |= more
        differ = np.bitwise_or.reduce(shifted ^ y[:, live, :n], axis=0)
        if o % 64:
            differ[:, n - 1] &= np.uint64((1 << (o % 64)) - 1)
        count = np.bitwise_count(differ).sum(axis=1, dtype=np.int32)
        less = count / o < share[live]
        some = live[less]
        best[some], bad[some], share[some] = o, count[less], count[less] / o
    return best, bad


def best_overlap(pdf_iter: Iterator[pd.DataFrame], min_overlap: int, max_share: float) -> Iterator[pd.DataFrame]:
    """Gap-free overlap of each pair with the smallest mismatch share; the longer one on ties.

    Overlap 0 means that no offset stays within ``max_share`` mismatches.
    """
    for pdf in pdf_iter:
        best, bad = np.zeros(len(pdf), np.int32), np.zeros(len(pdf), np.int32)
        order = np.argsort(np.minimum(pdf["fwd"].str.len(), pdf["rev_rc"].str.len()).to_numpy(), kind="stable")
        fwd, rev = pdf["fwd"].to_numpy(), pdf["rev_rc"].to_numpy()
        for at in range(0, len(order), _PAIRS):
            some = order[at : at + _PAIRS]
            best[some], bad[some] = overlaps(fwd[some].tolist(), rev[some].tolist(), min_overlap, max_share)
        yield pdf.assign(overlap=best, mismatches=bad)


def merge_pairs(
    forward: DataFrame, reverse: DataFrame, min_overlap: int = 10, max_share: float = 0.25
) -> DataFrame:
    """Contigs from forward and reverse reads ``(seq_id, seq, qual)`` of one fragment.

    The reverse read is reverse-complemented, laid over the end of the forward read at the offset
    with the smallest mismatch share, and each overlapping base is taken from the read with the
    higher quality (forward on ties). Pairs without an overlap of ``min_overlap`` bases and at most
    ``max_share`` mismatches are left out.
    """
    f = forward.select("seq_id", F.col("seq").alias("fwd"), F.col("qual").alias("fq"))
    r = reverse.select("seq_id", S.reverse_complement(F.col("seq")).alias("rev_rc"), F.reverse("qual").alias("rq"))
    joined = f.join(r, "seq_id")
    id_type = joined.schema["seq_id"].dataType.simpleString()
    laid = joined.mapInPandas(
        lambda it: best_overlap(it, min_overlap, max_share),
        f"seq_id {id_type}, fwd string, fq string, rev_rc string, rq string, overlap int, mismatches int",
    ).where(F.col("overlap") >= min_overlap)
    o, lf = F.col("overlap"), F.length("fwd")
    both = F.arrays_zip(
        F.split(F.substring(F.col("fwd"), lf - o + 1, o), "").alias("x"),
        F.split(F.substring(F.col("rev_rc"), F.lit(1), o), "").alias("y"),
        F.split(F.substring(F.col("fq"), lf - o + 1, o), "").alias("p"),
        F.split(F.substring(F.col("rq"), F.lit(1), o), "").alias("q"),
    )
    middle = F.array_join(F.transform(both, lambda t: F.when(t["q"] > t["p"], t["y"]).otherwise(t["x"])), "")
    seq = F.concat(
        F.substring(F.col("fwd"), F.lit(1), lf - o), middle,
        F.substring(F.col("rev_rc"), o + 1, F.length("rev_rc") - o),
    )
    return laid.select("seq_id", "overlap", "mismatches", seq.alias("seq"))


def alignment_column_filter(aligned: DataFrame, gap: str = "-", trump: str = ".") -> DataFrame:
    """Drop alignment columns with a ``trump`` character anywhere or gaps only.

    ``aligned(aln, seq_id, seq)``: sequences of one alignment have the same length. Columns are
    judged by a combined aggregation over positions; the mask, one entry per column, is joined back: broadcast under the
    size bound, so that the sequences of one large alignment are not moved to one task.
    """
    base = aligned.select("aln", F.posexplode(F.split("seq", "")).alias("pos", "ch"))
    keep = base.groupBy("aln", "pos").agg(
        (~F.bool_or(F.col("ch") == trump) & ~F.bool_and(F.col("ch").isin(gap, trump))).alias("keep")
    )
    # an alignment's width bounds the mask
    mask = keep.groupBy("aln").agg(F.array_sort(F.collect_list(F.struct("pos", "keep"))).alias("mask"))
    chars = F.zip_with(F.split("seq", ""), "mask", lambda c, m: F.struct(c.alias("c"), m["keep"].alias("k")))
    kept = F.array_join(F.transform(F.filter(chars, lambda t: t["k"]), lambda t: t["c"]), "")
    mask = checkpointed(mask)
    columns = mask.agg(F.sum(F.size("mask"))).first()[0] or 0
    return aligned.join(F.broadcast(mask) if 24 * columns <= BROADCAST_BYTES else mask, "aln").select("aln", "seq_id", kept.alias("seq"))


# ---------------------------------------------------------------- k-mers


def kmers(seq: Column, k: int) -> Column:
    """Distinct overlapping k-mers: a zero-width match at every position, linear in the text."""
    return F.array_distinct(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def template_search(queries: DataFrame, refs: DataFrame, k: int = 8, all_queries: bool = False) -> DataFrame:
    """Reference sharing the most distinct k-mers with each query; smallest ``ref_id`` on ties.

    A query that shares none has no row; with ``all_queries`` it has one without ``ref_id``, and ``shared`` 0.

    The reference words are written once and counted. Under the size bound they are broadcast, so that
    the counts per (query, reference) combine inside the task holding the query and its words are
    never shuffled; a larger reference set is joined by word.
    """
    q = queries.select("seq_id", F.explode(kmers(F.col("seq"), k)).alias("w"))
    r = checkpointed(refs.select("ref_id", F.explode(kmers(F.col("seq"), k)).alias("w")))
    r = broadcast_if_small(r, r.count(), 64)
    shared = q.join(r, "w").groupBy("seq_id", "ref_id").agg(F.count("*").alias("shared"))
    best = shared.groupBy("seq_id").agg(F.min_by(F.struct("ref_id", "shared"), F.struct(-F.col("shared"), "ref_id")).alias("b"))
    found = best.select("seq_id", "b.ref_id", "b.shared")
    if not all_queries:
        return found
    every = queries.select("seq_id").distinct().join(found, "seq_id", "left")
    return every.select("seq_id", "ref_id", F.coalesce("shared", F.lit(0)).alias("shared"))


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which two strings differ; a longer tail counts as differing."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), lambda t: t))


#: Bytes of the reference table that a task compares its reads with; more references go in several blocks.
_REFERENCE_BLOCK = 16 * 1024 * 1024


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fewest_mismatches(queries: DataFrame, refs: DataFrame, block_bytes: int = _REFERENCE_BLOCK) -> DataFrame:
    """``(seq_id, n, errors)``: each sequence's smallest number of mismatches to any reference.

    Sequences are laid over a reference from the first character on and a longer tail counts as differing, as in
    ``mismatches``. Every sequence gets a row; ``errors`` is NULL only if there is no reference. The references are
    the stated query set: they reach the tasks in blocks of bounded size, and the minimum is taken over the blocks.
    """
    spark = queries.sparkSession
    src = queries.where(F.col("seq").isNotNull()).select("seq_id", "n", "seq")
    known = checkpointed(refs.where(F.col("seq").isNotNull()).select("seq"))
    size = known.agg(F.count("*").alias("k"), F.max(F.length("seq")).alias("width")).first()  # two numbers
    if not size["k"]:
        return src.select("seq_id", "n", F.lit(None).cast("int").alias("errors"))
    blocks = max(1, math.ceil(4 * size["k"] * max(1, size["width"]) / block_bytes))
    types = {c: src.schema[c].dataType.simpleString() for c in ("seq_id", "n")}

    def compare(block) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [_codes(t) for t in block.value]
            sizes = np.array([len(r) for r in rows])
            width = int(sizes.max())
            laid = np.full((len(rows), width), np.iinfo(np.uint32).max, np.uint32)  # no character has that code
            for i, r in enumerate(rows):
                laid[i, : len(r)] = r

            def fewest(text: str) -> int:
                x = _codes(text)
                same = np.count_nonzero(laid[:, : len(x)] == x[:width], axis=1)
                return int((np.maximum(sizes, len(x)) - same).min())

            for pdf in pdfs:
                errors = np.array([fewest(t) for t in pdf["seq"]], np.int32)
                yield pdf[["seq_id", "n"]].assign(errors=errors)

        return run

    out = None
    for b in range(blocks):
        part = [r["seq"] for r in known.where(F.pmod(F.xxhash64("seq"), F.lit(blocks)) == b).collect()]  # one block
        if part:
            found = src.mapInPandas(
                compare(spark.sparkContext.broadcast(part)), f"seq_id {types['seq_id']}, n {types['n']}, errors int"
            )
            out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out
    return out.groupBy("seq_id").agg(F.first("n").alias("n"), F.min("errors").alias("errors"))


def reference_error_histogram(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """``(errors, sequences)``: fewest mismatches of each sequence over all references, weighted by its count."""
    return fewest_mismatches(queries, refs).groupBy("errors").agg(F.sum("n").alias("sequences"))


def nb_classify(queries: DataFrame, train: DataFrame, k: int = 8, all_queries: bool = False) -> DataFrame:
    """Naive-Bayes class of each query and its log score, sum(log((n_wk + prior_w) / (N_k + 1))) over its distinct words.

    A query without a word has no row; with ``all_queries`` it has one without ``taxon``, its score the empty sum, 0.
    Texts that are queries and training texts at once (``queries`` is ``train``) are read and moved once.

    The sum splits into a class-free part, a part for the words a class has seen, and the class size, so only seen
    (word, class) pairs are summed (``words.class_sums``). A class sharing no word can win only if it is the smallest
    one, hence that extra candidate.
    """
    sizes = train.groupBy("taxon").agg(F.count("*").alias("nk"))
    numbered = sizes.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(
        T.StructType([*sizes.schema.fields, T.StructField("class", T.IntegerType())])
    )
    sizes = checkpointed(numbered)
    seen = sizes.agg(
        F.count("*").alias("classes"), F.sum("nk").alias("total"), F.max(F.expr("IF(taxon IS NULL, class, -1)")).alias("none"),
        F.min_by(F.struct("taxon", "nk"), F.struct("nk", "taxon")).alias("low"),
    ).first()
    classes = broadcast_if_small(sizes.select(F.col("taxon").alias("_t"), "class"), seen["classes"], 64)
    known = train.join(classes, F.col("taxon").eqNullSafe(F.col("_t")))
    if queries is train:
        texts = known.select("seq_id", F.lit(True).alias("asked"), "class", "seq")
    else:
        kind = queries.schema["seq_id"].dataType
        texts = queries.select("seq_id", F.lit(True).alias("asked"), F.lit(None).cast("int").alias("class"), "seq").unionByName(
            known.select(F.lit(None).cast(kind).alias("seq_id"), F.lit(False).alias("asked"), "class", "seq"))
    per = class_sums(texts, k, seen["classes"], seen["none"], seen["total"]).groupBy("seq_id", "class").agg(
        F.sum("g").alias("g"), F.sum("flat").alias("flat"), F.sum("nq").alias("nq")
    )
    low = seen["low"]
    # one entry per class of the key
    joined = per.join(broadcast_if_small(sizes, seen["classes"], 64), "class", "left").groupBy("seq_id").agg(
        F.expr("sum(flat) AS flat"), F.expr("sum(nq) AS nq"),
        F.expr("collect_list(CASE WHEN class IS NOT NULL THEN struct(taxon, g, nk) END) AS c"),
    )
    extra = F.struct(F.lit(low["taxon"]).alias("taxon"), F.lit(0.0).alias("g"), F.lit(low["nk"]).alias("nk"))
    loss = "transform(c, x -> struct(-(flat + x.g - nq * ln(x.nk + 1)) AS loss, x.taxon AS taxon))"
    best = joined.withColumn("c", F.concat("c", F.array(extra))).selectExpr("seq_id", f"array_min({loss}) AS b")
    scored = best.select("seq_id", "b.taxon", (-F.col("b.loss")).alias("score"))
    if not all_queries:
        return scored
    every = queries.select("seq_id").distinct().join(scored, "seq_id", "left")
    return every.select("seq_id", "taxon", F.coalesce("score", F.lit(0.0)).alias("score"))


def _word_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive characters."""
    out = np.zeros(max(0, len(codes) - k + 1), np.uint64)
    for i in range(k):
        out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _count_words(shared, k: int):
    """Texts that hold each word of a vocabulary, ``(w, taxon, n)``, summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.string())
        codes = _codes("".join(shared.value)).reshape(-1, k)
        names = np.array([_word_hashes(c, k)[0] for c in codes], np.uint64)
        order = np.argsort(names)
        names = names[order]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                taxa = b.column(0).dictionary_encode()
                found = []
                for taxon, text in zip(taxa.indices.to_pylist(), b.column(1).to_pylist()):
                    own = _codes(text or "")
                    h = _word_hashes(own, k)
                    place = np.searchsorted(names, h)
                    hit = np.flatnonzero(names[np.minimum(place, len(names) - 1)] == h)
                    word = order[place[hit]]
                    same = (own[hit[:, None] + np.arange(k)] == codes[word]).all(axis=1)
                    found.append(np.unique(word[same]) + (-1 if taxon is None else taxon) * len(codes))
                cells, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        vocabulary.take(pa.array(cells % len(codes))),
                        taxa.dictionary.take(pa.array(cells // len(codes), mask=cells < 0)), pa.array(n),
                    ],
                    names=["w", "taxon", "n"],
                )

    return run


def vocabulary_model(train: DataFrame, vocabulary: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(w, lp, classes)`` for every word of ``vocabulary(w)``, and the class sizes ``(taxon, nk)``.

    ``lp`` is the word's log prior, ``classes`` the classes that have seen it with their gain and ``ln(nk + 1)``. Under
    the size bound the vocabulary is broadcast and the training texts are read once, without a row per word; a larger
    one is joined by word.
    """
    vocabulary = checkpointed(vocabulary.select("w").distinct())
    count = vocabulary.count()
    labelled = train.select(F.col("taxon").cast("string").alias("taxon"), "seq")
    sizes = checkpointed(labelled.groupBy("taxon").agg(F.count("*").alias("nk")))
    total = sizes.agg(F.sum("nk")).first()[0] or 0
    if 64 * (k + 16) * count <= BROADCAST_BYTES:
        words = [r["w"] for r in vocabulary.collect()]  # bounded by the line above
        shared = train.sparkSession.sparkContext.broadcast(words)
        seen = labelled.mapInArrow(_count_words(shared, k), "w string, taxon string, n long") if words else None
    else:
        seen = labelled.select("taxon", F.explode(kmers(F.col("seq"), k)).alias("w")).join(vocabulary, "w", "left_semi").withColumn(
            "n", F.lit(1).cast("long"))
    if seen is None:
        seen = train.sparkSession.createDataFrame([], "w string, taxon string, n long")
    seen = seen.where("taxon IS NOT NULL").groupBy("w", "taxon").agg(F.sum("n").alias("nwk"))
    sized = seen.join(broadcast_if_small(sizes, sizes.count(), 64), "taxon")
    # a word has one entry per class
    per = sized.groupBy("w").agg(F.sum("nwk").alias("all"), F.array_sort(F.collect_list(F.struct("taxon", "nwk", "nk"))).alias("c"))
    prior = (F.coalesce("all", F.lit(0)) + 0.5) / (total + 1)
    joined = vocabulary.join(per, "w", "left").withColumn("pw", prior)
    entry = "transform(c, x -> struct(x.taxon AS taxon, ln((x.nwk + pw) / pw) AS gain, ln(x.nk + 1) AS size))"
    return checkpointed(joined.selectExpr("w", "ln(pw) AS lp", f"coalesce({entry}, array()) AS classes")), sizes


#: Cells of a score table (words of a sequence x draws) that are summed at a time.
_SCORE_CELLS = 4_000_000


def draw_votes(lp: np.ndarray, chosen: np.ndarray, word: np.ndarray, klass: np.ndarray, gain: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best class of every draw, -1 for one without a word.

    ``chosen`` (words x draws) tells which words a draw has; entry ``i`` gives class ``klass[i]`` the ``gain[i]`` of
    word ``word[i]``; ``size`` is the logarithm of each class's size. Of equal scores the lower class.
    """
    scores = np.zeros((len(size), chosen.shape[1]))
    order = np.argsort(klass, kind="stable")
    step = max(1, _SCORE_CELLS // chosen.shape[1])
    for at in range(0, len(order), step):
        some = order[at : at + step]
        own = klass[some]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        scores[own[starts]] += np.add.reduceat(chosen[word[some]] * gain[some, None], starts, axis=0)
    n = chosen.sum(axis=0)
    best = (lp @ chosen + scores - n * size[:, None]).argmax(axis=0)
    best[n == 0] = -1
    return best


def _vote(iters: int, low: tuple[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = b.column(1)[i].values
                lp = words.field("lp").to_numpy()
                digits = np.frombuffer("".join(words.field("digits").to_pylist()).encode(), np.uint8).reshape(len(lp), -1)
                chosen = np.ones((len(lp), iters + 1))  # the last column is the whole sequence
                chosen[:, :iters] = digits[:, :iters] < ord("2")
                lists = words.field("classes")
                own = lists.flatten()
                taxa, klass = np.unique(np.array([*own.field("taxon").to_pylist(), low[0]], object), return_inverse=True)
                size = np.empty(len(taxa))
                size[klass] = [*own.field("size").to_pylist(), low[1]]
                word = np.repeat(np.arange(len(lp)), lists.value_lengths().to_numpy(zero_copy_only=False))
                best = draw_votes(lp, chosen, word, klass[:-1], own.field("gain").to_numpy(), size)
                drawn, votes = np.unique(best[:iters][best[:iters] >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, 1), pa.array([taxa[best[-1]]], pa.string()),
                        pa.array([[{"drawn": str(taxa[t]), "n": int(n)} for t, n in zip(drawn, votes)]],
                                 pa.list_(pa.struct([("drawn", pa.string()), ("n", pa.int64())]))),
                    ],
                    names=["seq_id", "taxon", "votes"],
                )

    return run


def nb_bootstrap(
    queries: DataFrame, train: DataFrame, lineages: DataFrame, k: int = 8, iters: int = 100, cutoff: int = 80,
    seed: int = 1,
) -> DataFrame:
    """Class with bootstrap confidence per rank; ranks under ``cutoff`` become ``unclassified``.

    Each iteration scores an eighth of the query's words, those whose hexadecimal digit of the draw is 0 or 1 (digits are
    those of md5 of seed, number of 32 draws, and word); one that draws no word casts no vote. ``lineages(taxon, ranks)``
    holds the rank names from the root down. A query without any vote is ``unclassified`` at confidence 0 on every rank, one
    without a word on all ranks of the deepest lineage and without ``taxon``.

    All draws of a query are scored at once in a table of its classes x draws; words, draws and classes are never
    crossed as rows. A task holds the words of one query at a time.
    """
    words = checkpointed(queries.select("seq_id", F.explode(kmers(F.col("seq"), k)).alias("w")))
    model, sizes = vocabulary_model(train, words.select("w"), k)
    low = sizes.where("taxon IS NOT NULL").agg(F.min_by(F.struct("taxon", "nk"), F.struct("nk", "taxon")).alias("b")).first()["b"]
    deepest = lineages.agg(F.max(F.size("ranks"))).first()[0] or 0
    if low is None:
        named = None
    else:
        blocks = range(-(-iters // 32))
        digits = F.concat(*[F.md5(F.concat(F.lit(f"{seed}-{j}-"), F.col("w"))) for j in blocks])
        entries = model.agg(F.count("*"), F.sum(F.size("classes"))).first()
        if 64 * (entries[0] + (entries[1] or 0)) <= BROADCAST_BYTES:
            model = F.broadcast(model)
        per = words.join(model, "w").groupBy("seq_id").agg(
            F.array_sort(F.collect_list(F.struct("w", "lp", digits.alias("digits"), "classes"))).alias("words")
        )
        kind = queries.schema["seq_id"].dataType.simpleString()
        voted = per.mapInArrow(
            _vote(iters, (low["taxon"], math.log(low["nk"] + 1))), f"seq_id {kind}, taxon string, votes array<struct<drawn:string,n:bigint>>"
        )
        voted = checkpointed(voted)
        ranks = lineages.select(F.col("taxon").cast("string").alias("taxon"), "ranks")
        one = F.explode_outer("votes").alias("v")
        votes = (
            voted.join(ranks, "taxon").select("seq_id", "taxon", "ranks", one)
            .join(ranks.withColumnsRenamed({"taxon": "_t", "ranks": "drawn"}), F.col("v.drawn") == F.col("_t"), "left")
            .select("seq_id", "taxon", F.posexplode("ranks").alias("depth", "name"), "ranks", "drawn", F.coalesce("v.n", F.lit(0)).alias("n"))
        )
        prefix = lambda a: F.slice(a, 1, F.col("depth") + 1)
        same = F.sum(F.when(prefix(F.col("ranks")) == prefix(F.col("drawn")), F.col("n")).otherwise(0))
        conf = F.coalesce(100 * same / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))
        named = votes.groupBy("seq_id", "taxon", "depth", "name").agg(conf.alias("conf")).select(
            "seq_id", "taxon", (F.col("depth") + 1).alias("rank"),
            F.when(F.col("conf") >= cutoff, F.col("name")).otherwise("unclassified").alias("name"), "conf",
        )
    blank = queries.select("seq_id").distinct()
    if named is not None:
        blank = blank.join(words, "seq_id", "left_anti")
    levels = F.explode(F.sequence(F.lit(1), F.lit(deepest))) if deepest else F.explode(F.array().cast("array<int>"))
    empty = blank.select(
        "seq_id", F.lit(None).cast("string").alias("taxon"), levels.alias("rank"), F.lit("unclassified").alias("name"),
        F.lit(0.0).alias("conf"),
    )
    return empty if named is None else named.unionByName(empty)


# ---------------------------------------------------------------- near pairs


def threshold_pairs(seqs: DataFrame, cutoff: float = 0.03) -> DataFrame:
    """Distance list below the cutoff: mismatches over length. ``near_pairs`` has written it, as its users read it often."""
    pairs = near_pairs(seqs, lambda n: F.floor(n * F.lit(cutoff) + 1e-9))
    return pairs.select("a", "b", (F.col("diffs") / F.col("len")).alias("dist"))


def precluster(unique: DataFrame, diffs: int = 2) -> DataFrame:
    """Greedy merging by abundance: ``(seq_id, rep, size)`` with ``size`` the summed counts of ``rep``.

    ``unique(seq_id, seq, n)``. A scan in the order (largest ``n``, smallest id) makes every sequence that
    is not merged yet a centre and merges its later neighbours within ``diffs`` into it. The same result in
    rounds: a sequence waits for its earliest neighbour that is not merged itself. Is that one a centre, the
    sequence joins it; is there none, the sequence is a centre. The earliest waiting sequence is settled in
    every round, so the rounds end by themselves; each is a grouped minimum over the remaining links.
    """
    n = unique.select("seq_id", "n")
    sized = (
        near_pairs(unique, lambda _: F.lit(diffs))
        .join(n.withColumnsRenamed({"seq_id": "a", "n": "na"}), "a")
        .join(n.withColumnsRenamed({"seq_id": "b", "n": "nb"}), "b")
    )
    # ids are ordered a < b, so a tie in counts puts a first
    first = F.col("na") >= F.col("nb")
    links = sized.select(
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("seq_id"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("to"),
        F.greatest("na", "nb").alias("nt"),
    )
    links = checkpointed(links)
    waiting = links.select(F.col("seq_id").alias("to")).distinct().withColumn("_w", F.lit(True))
    links = checkpointed(links.join(waiting, "to", "left").select("seq_id", "to", "nt", F.col("_w").isNull().alias("centre")))
    merged = None
    while links.take(1):
        lead = links.groupBy("seq_id").agg(F.min_by(F.struct("to", "centre"), F.struct(-F.col("nt"), "to")).alias("e"))
        joined = checkpointed(lead.where("e.centre").select("seq_id", F.col("e.to").alias("rep")))
        merged = joined if merged is None else merged.unionByName(joined)
        gone = joined.select(F.col("seq_id").alias("to"))
        rest = links.join(joined, "seq_id", "left_anti")
        kept = checkpointed(rest.join(gone, "to", "left_anti").select("seq_id", "to", "nt", "centre"))
        still = kept.select("seq_id").distinct()
        centres = rest.select("seq_id").distinct().join(still, "seq_id", "left_anti").select(
            F.col("seq_id").alias("to"), F.lit(True).alias("_c")
        )
        links = checkpointed(kept.join(centres, "to", "left").select(
            "seq_id", "to", "nt", (F.col("centre") | F.col("_c").isNotNull()).alias("centre")
        ))
    if merged is None:
        return unique.select("seq_id", F.col("seq_id").alias("rep"), F.col("n").alias("size"))
    out = n.join(merged, "seq_id", "left").withColumn("rep", F.coalesce("rep", "seq_id"))
    return out.select("seq_id", "rep").join(out.groupBy("rep").agg(F.sum("n").alias("size")), "rep").select(
        "seq_id", "rep", "size"
    )


# ---------------------------------------------------------------- clusters


def connected_components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(seq_id, cluster)`` with the smallest member id as cluster, by alternating star steps.

    Large-star links every larger neighbour to the smallest neighbour, small-star links smaller ones;
    both are a minimum per node joined back to the edges, so no neighbourhood is gathered. Edges are
    checkpointed each round and the loop ends when a round leaves the edge set unchanged.
    """
    edges = checkpointed(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    state = None
    for _ in range(max_rounds):
        # large star
        nbr = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = nbr.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = nbr.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours to the smallest of them
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(
            F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        )
        edges = checkpointed(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("seq_id").join(edges.select(F.col("u").alias("seq_id"), F.col("v").alias("cluster")), "seq_id", "left").select(
        "seq_id", F.coalesce("cluster", "seq_id").alias("cluster")
    )


def cluster_mcc(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Confusion counts and Matthews correlation of a clustering against the distance list.

    Same-cluster and total pair numbers come from cluster sizes; no pair is enumerated.
    """
    ca = clusters.select(F.col("seq_id").alias("a"), F.col("cluster").alias("ca"))
    cb = clusters.select(F.col("seq_id").alias("b"), F.col("cluster").alias("cb"))
    hit = pairs.join(ca, "a").join(cb, "b").agg(
        F.count_if(F.col("ca") == F.col("cb")).alias("tp"), F.count_if(F.col("ca") != F.col("cb")).alias("fn")
    )
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("k")).agg(
        F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("same"), F.sum("k").alias("n")
    )
    s = sizes.first()  # two numbers
    every = s["n"] * (s["n"] - 1) // 2
    c = hit.select(
        "tp", "fn", (F.lit(s["same"]) - F.col("tp")).alias("fp"), (F.lit(every - s["same"]) - F.col("fn")).alias("tn")
    )
    tp, fn, fp, tn = (F.col(x).cast("double") for x in ("tp", "fn", "fp", "tn"))
    return c.withColumn(
        "mcc", (tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))
    )


def cluster_medoid(pairs: DataFrame, clusters: DataFrame, abundance: DataFrame) -> DataFrame:
    """Representative of each cluster: smallest largest distance to the other members.

    Distances come from the sparse list; a member with an unlisted partner counts 1.0, as that
    partner is beyond the cutoff. Ties go to the more abundant, then to the smaller id.
    """
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("seq_id"), F.col("b").alias("other"), "dist"),
        F.struct(F.col("b").alias("seq_id"), F.col("a").alias("other"), "dist"),
    )))
    other = clusters.select(F.col("seq_id").alias("other"), F.col("cluster").alias("oc"))
    inside = both.join(clusters, "seq_id").join(other, "other").where(F.col("cluster") == F.col("oc"))
    far = inside.groupBy("seq_id").agg(F.max("dist").alias("far"), F.count("*").alias("listed"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    scored = (
        clusters.join(size, "cluster").join(far, "seq_id", "left").join(abundance, "seq_id")
        .withColumn("far", F.when(F.coalesce("listed", F.lit(0)) < F.col("size") - 1, F.lit(1.0)).otherwise(
            F.coalesce("far", F.lit(0.0))))
    )
    return scored.groupBy("cluster").agg(
        F.first("size").alias("size"), F.min_by("seq_id", F.struct("far", -F.col("n"), "seq_id")).alias("medoid"),
        F.min("far").alias("far"),
    )


def consensus_taxonomy(members: DataFrame, cutoff: int = 51) -> DataFrame:
    """Consensus lineage per cluster from ``(otu, n, ranks)``, ``ranks`` an array of names.

    Every member votes with its abundance for its lineage prefixes; a rank stays while the leading
    prefix below the kept one holds at least ``cutoff`` percent, deeper ranks repeat the last
    kept name with ``_unclassified``.
    """
    votes = members.select(
        "otu", "n", F.explode(F.transform("ranks", lambda x, i: F.slice("ranks", 1, i + 1))).alias("path")
    ).groupBy("otu", "path").agg(F.sum("n").alias("votes"))
    total = members.groupBy("otu").agg(F.sum("n").alias("size"), F.max(F.size("ranks")).alias("depth"))
    lead = (
        votes.withColumn("d", F.size("path")).groupBy("otu", "d")
        .agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), "path")).alias("b"))
        .select("otu", "d", "b.path", "b.votes")
        .join(total, "otu")
        .withColumn("conf", F.round(100 * F.col("votes") / F.col("size")).cast("int"))
        .where(100 * F.col("votes") >= cutoff * F.col("size"))
    )
    # a majority prefix extends the majority prefix above it; ranks per lineage are few
    kept = lead.groupBy("otu").agg(
        F.array_sort(F.collect_list(F.struct("d", F.element_at("path", -1).alias("name"), "conf"))).alias("kept")
    )
    named = F.transform("kept", lambda x: F.concat(x["name"], F.lit("("), x["conf"].cast("string"), F.lit(");")))
    last = F.element_at("kept", -1)
    k = F.coalesce(F.size("kept"), F.lit(0))
    fill = F.when(F.col("k") == 0, F.lit("unclassified(100);")).otherwise(
        F.concat(last["name"], F.lit("_unclassified("), last["conf"].cast("string"), F.lit(");"))
    )
    return (
        total.join(kept, "otu", "left").withColumn("k", F.when(F.col("kept").isNull(), 0).otherwise(k))
        .select(
            "otu", "size",
            F.concat(
                F.when(F.col("k") > 0, F.array_join(named, "")).otherwise(""),
                F.when(F.col("depth") > F.col("k"), F.array_join(F.array_repeat(fill, F.col("depth") - F.col("k")), "")).otherwise(""),
            ).alias("taxonomy"),
        )
    )
