"""Sequence operators against brute force on small fixtures."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import blocking as B
from tallyfield.operators import chimera as C
from tallyfield.operators import seqs as Q
from tallyfield.operators import words as W
from tallyfield.sources import tables as T


def family(seed=1, n=120, length=24):
    """Mutants of two templates, so that many segments are shared by a third of the sequences."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(2)]
    out = {"A", "AC", "CA", "G"}
    while len(out) < n:
        s = list(base[len(out) % 3 == 0])
        for _ in range(rng.randrange(0, 5)):
            s[rng.randrange(length)] = rng.choice("ACGT")
        out.add("".join(s))
    return sorted(out)


def frame(spark, texts, counts=None):
    rows = [(i, s, (counts or {}).get(i, 1)) for i, s in enumerate(texts)]
    return spark.createDataFrame(rows, "seq_id long, seq string, n long")


def diff(a, b):
    return sum(x != y for x, y in zip(a, b))


def near(texts, allowed):
    return {
        (i, j): diff(a, b)
        for i, a in enumerate(texts) for j, b in enumerate(texts)
        if i < j and len(a) == len(b) and diff(a, b) <= allowed(len(a))
    }


@pytest.mark.parametrize("d", [0, 1, 2, 5])
def test_near_pairs_have_full_recall(spark, d):
    texts = family()
    out = Q.near_pairs(frame(spark, texts), lambda n: F.lit(d)).collect()
    got = {(r["a"], r["b"]): r["diffs"] for r in out}
    assert len(out) == len(got) and got == near(texts, lambda n: d)


@pytest.mark.parametrize("hot", [2000, 5])
def test_near_pairs_of_other_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(B, "HOT", hot)
    rng = random.Random(6)
    texts = {"", "a", "b", "é", "漢字", "漢学", "😀b", "😀c"}
    texts |= {"".join(rng.choice("ab😀") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    texts |= {"".join(rng.choice("xy") for _ in range(9)) + "z" * 20 for _ in range(100)}
    texts = sorted(texts)
    for allowed, plain in ((lambda n: F.lit(2), lambda n: 2), (lambda n: F.floor(n / 7), lambda n: n // 7)):
        out = Q.near_pairs(frame(spark, texts).withColumn("seq_id", F.col("seq_id").cast("string")), allowed).collect()
        got = {tuple(sorted((int(r["a"]), int(r["b"])))): (r["diffs"], r["len"]) for r in out}
        assert len(got) == len(out)
        assert got == {k: (v, len(texts[k[0]])) for k, v in near(texts, plain).items()}


@pytest.mark.parametrize("limits", [{}, {"DIRECT": 1}, {"DIRECT": 1, "GROUP_PAIRS": 20}, {"GROUP_CHARS": 150}, {"GROUP_ROWS": 1, "HOT": 5}])
def test_every_way_gives_the_near_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(B, name, value)
    rng = random.Random(8)
    texts = {"".join(rng.choice("ab😀") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    texts |= {"".join(rng.choice("xyé") for _ in range(9)) + "z" * 20 for _ in range(100)}
    texts = sorted({*texts, *family()})
    for allowed, plain in ((lambda n: F.lit(2), lambda n: 2), (lambda n: F.floor(n / 5), lambda n: n // 5)):
        out = Q.near_pairs(frame(spark, texts), allowed).collect()
        got = {tuple(sorted((r["a"], r["b"]))): (r["diffs"], r["len"]) for r in out}
        assert len(got) == len(out) and all(r["a"] < r["b"] for r in out)
        assert got == {k: (v, len(texts[k[0]])) for k, v in near(texts, plain).items()}


def test_keys_of_a_length_that_fits_a_task_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(B, "candidates", None)
    texts = family()
    assert len(Q.near_pairs(frame(spark, texts), lambda n: F.lit(2)).collect()) == len(near(texts, lambda n: 2))


def test_a_variable_region_does_not_make_every_pair_a_candidate(spark):
    rng = random.Random(12)
    body = "".join(rng.choice("ACGT") for _ in range(220))
    texts = sorted({body[:100] + "".join(rng.choice("ACGT") for _ in range(30)) + body[100:] for _ in range(3000)})
    base = frame(spark, texts).select("seq_id", "seq", F.length("seq").alias("len"), F.lit(7).alias("d"))
    pairs = B.candidates(base.cache()).count()
    assert pairs < 10 * len(texts)  # of 4,498,500


def test_threshold_pairs_and_components(spark):
    texts = family(2)
    df = frame(spark, texts)
    pairs = Q.threshold_pairs(df, 0.09)
    want = near(texts, lambda n: int(n * 0.09 + 1e-9))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == set(want)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["seq_id"]: r["cluster"] for r in Q.connected_components(df, pairs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_components_on_a_star_and_a_long_chain(spark):
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)]
    nodes = spark.createDataFrame([(i,) for i in [*range(40), *range(100, 161), 500]], "seq_id long")
    pairs = spark.createDataFrame(edges, "a long, b long")
    got = {r["seq_id"]: r["cluster"] for r in Q.connected_components(nodes, pairs).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[i] == 100 for i in range(100, 161)) and got[500] == 500


def test_precluster_is_the_greedy_scan(spark):
    texts = family(3)
    rng = random.Random(8)
    counts = {i: rng.choice([1, 1, 2, 5, 9, 30]) for i in range(len(texts))}
    pairs = near(texts, lambda n: 2)
    linked = {frozenset((a, b)) for a, b, *_ in pairs}
    order = sorted(range(len(texts)), key=lambda i: (-counts[i], i))
    rep = {}
    for at, i in enumerate(order):
        if i not in rep:
            rep[i] = i
            for j in order[at + 1 :]:
                if j not in rep and frozenset((i, j)) in linked:
                    rep[j] = i
    got = Q.precluster(frame(spark, texts, counts)).collect()
    assert {r["seq_id"]: r["rep"] for r in got} == rep
    assert len(got) == len(texts)
    for r in got:
        assert r["size"] == sum(counts[i] for i in rep if rep[i] == r["rep"])


def test_precluster_chain_and_equal_counts(spark):
    # the third is within two of the second only, which is merged by then; equal counts do merge
    texts = ["AAAAAAAA", "CCAAAAAA", "CCCCAAAA", "GGGGGGGG", "GGGGGGGT"]
    got = Q.precluster(frame(spark, texts, {0: 100, 1: 50, 2: 10, 3: 4, 4: 4})).collect()
    assert {r["seq_id"]: (r["rep"], r["size"]) for r in got} == {
        0: (0, 150), 1: (0, 150), 2: (2, 10), 3: (3, 8), 4: (3, 8)
    }
    alone = Q.precluster(frame(spark, ["ACGT", "TTTTTT"], {0: 2, 1: 1})).collect()
    assert {(r["seq_id"], r["rep"], r["size"]) for r in alone} == {(0, 0, 2), (1, 1, 1)}


def _chimera(t, big):
    if any(u.startswith(t) or u.endswith(t) for u in big):
        return False
    return any(u[:k] == t[:k] and w.endswith(t[k:]) for k in range(1, len(t)) for u in big for w in big if u != w)


def test_bimera_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    parents = [make(12) for _ in range(3)] + [make(10), make(15)]
    a, b, c, d, e = parents
    made = [a[:5] + b[5:], c[:9] + d[-3:], "ACGTACGTACGA", a[:4] + "TTTTTTTT", d[:6] + e[-4:], e[:7] + d[-7:], a + b[-2:],
            a[:4] + a[6:], a[:8], b[3:], e[:5] + e[9:]]
    rows = [("s1", i, p, 20 + i) for i, p in enumerate(parents)] + [("s1", 10 + i, m, 3) for i, m in enumerate(made)]
    rows += [("s2", 10, made[0], 3), ("s2", 0, parents[0], 20)]  # the second parent is missing in this sample
    # a read with a gap, alone with its parent and with a second parent of the same start
    gap = a[:4] + a[6:]
    rows += [("s3", 0, a, 20), ("s3", 17, gap, 3), ("s4", 0, a, 20), ("s4", 17, gap, 3), ("s4", 30, a[:6] + "CCCC", 9)]
    counts = spark.createDataFrame([(i, s, n) for s, i, _, n in rows], "seq_id long, sample string, n long")
    seqs = spark.createDataFrame(sorted({(i, t) for _, i, t, _ in rows}), "seq_id long, seq string")
    got = {(r["sample"], r["seq_id"]): r["chimera"] for r in Q.bimera_flag(counts, seqs).collect()}
    for s, i, t, n in rows:
        assert got[(s, i)] == _chimera(t, [u for v, _, u, m in rows if v == s and m >= 2 * n]), (s, i)
    assert got[("s1", 10)] and got[("s1", 14)] and not got[("s2", 10)]
    assert not got[("s3", 17)] and got[("s4", 17)]
    every = Q.bimera_flag(counts, seqs, dereplicate=False).collect()
    assert {(r["sample"], r["seq_id"]) for r in every if r["chimera"]} >= {("s1", 10), ("s2", 10)}


def test_best_two_parents(monkeypatch):
    import numpy as np

    rng = random.Random(7)
    for trial in range(200):
        texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))})
        n = np.array([rng.choice([1, 2, 3, 5, 9, 30]) for _ in texts])
        lcp = np.array([C.common_start(a, b) for a, b in zip(texts, texts[1:])], np.int64)
        assert lcp.tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(texts, texts[1:])]
        places, starts = C.two_best(n, lcp, np.arange(len(n)), 2 * n)
        for i, t in enumerate(texts):
            want = sorted((len(os.path.commonprefix([t, u])) for j, u in enumerate(texts) if n[j] >= 2 * n[i]), reverse=True)[:2]
            got = [(int(p), int(k)) for p, k in zip(places[:, i], starts[:, i]) if p >= 0]
            assert [k for _, k in got] == want and len({p for p, _ in got}) == len(got)
            assert all(n[p] >= 2 * n[i] and len(os.path.commonprefix([t, texts[p]])) == k for p, k in got)


@pytest.mark.parametrize("way", ["few parents", "sorted", "sorted, many guests"])
def test_bimera_over_many_ranges(spark, monkeypatch, way):
    if way != "few parents":
        monkeypatch.setattr(C, "best_parents", C._sorted_parents)
    if way == "sorted, many guests":
        monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    rng = random.Random(14)
    rows = []
    for sample, size in (("big", 400), ("b", 30), ("c", 1), (None, 40)):
        pool = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(6, 20))) for _ in range(12)]
        texts = set(pool) | {"", "é漢"}
        while len(texts) < size:
            a, b = rng.choice(pool), rng.choice(pool)
            k = rng.randrange(1, len(a))
            texts.add(rng.choice([a[:k] + b[k:], a[:k] + rng.choice("ACGT") + a[k:], a[:k], b[k:], a[:k] + a[k + 1 :]]))
        rows += [(sample, t, rng.choice([1, 2, 4, 8, 40])) for t in sorted(texts)]
    counts = spark.createDataFrame([(t, s, n) for s, t, n in rows], "seq_id string, sample string, n long")
    seqs = counts.select("seq_id", F.col("seq_id").alias("seq")).distinct()
    found = {(r["sample"], r["seq_id"]): r for r in Q.bimera_flag(counts, seqs).collect()}
    assert len(found) == len(rows) and sum(r["chimera"] for r in found.values()) > 30
    for s, t, n in rows:
        parents = [u for x, u, m in rows if x == s and m >= 2 * n]
        r = found[s, t]
        assert r["prefix"] == max((len(os.path.commonprefix([t, u])) for u in parents), default=0), (s, t)
        assert r["suffix"] == max((len(os.path.commonprefix([t[::-1], u[::-1]])) for u in parents), default=0)
        assert r["chimera"] == _chimera(t, parents), (s, t)


def test_merge_pairs_with_errors(spark):
    full = "ACGTTGCAACGGTTAACCGATCGATTGCACGT"
    comp = str.maketrans("ACGT", "TGCA")
    fwd = full[:20][:18] + "T" + full[19]  # one wrong base inside the overlap
    rev = full[8:][::-1].translate(comp)
    f = spark.createDataFrame([(1, fwd, "I" * 18 + "#I"), (2, "A" * 12, "I" * 12)], "seq_id long, seq string, qual string")
    r = spark.createDataFrame([(1, rev, "F" * len(rev)), (2, "G" * 12, "I" * 12)], "seq_id long, seq string, qual string")
    got = Q.merge_pairs(f, r, min_overlap=6).collect()
    assert [(x["seq_id"], x["overlap"], x["mismatches"], x["seq"]) for x in got] == [(1, 12, 1, full)]


def test_overlaps_against_every_offset(monkeypatch):
    import pandas as pd

    rng = random.Random(3)
    for alphabet in ("ACGT", "ab", "ACGTN-é漢😀", "z"):
        make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
        fwd, rev = [], []
        for _ in range(120):
            shared = make(rng.choice([0, 5, 30, 64, 65, 128, 200]))
            a = list(make(rng.randrange(0, 90)) + shared)
            for _ in range(rng.randrange(0, 6)):
                if a:
                    a[rng.randrange(len(a))] = rng.choice(alphabet)
            fwd.append("".join(a))
            rev.append(shared + make(rng.randrange(0, 90)))
        monkeypatch.setattr(Q, "_PAIRS", 50)
        out = next(Q.best_overlap(iter([pd.DataFrame({"fwd": fwd, "rev_rc": rev})]), 4, 0.25))
        for a, b, o, m in zip(fwd, rev, out["overlap"], out["mismatches"]):
            found = [(diff(a[len(a) - k :], b[:k]) / k, -k) for k in range(4, min(len(a), len(b)) + 1)]
            share, k = min([x for x in found if x[0] <= 0.25], default=(0, 0))
            assert (o, m) == (-k, round(share * -k))


def test_alignment_columns(spark):
    df = spark.createDataFrame([(1, 1, "A-C.G"), (1, 2, "A-CTG"), (1, 3, "--CTG")], "aln long, seq_id long, seq string")
    got = {r["seq_id"]: r["seq"] for r in Q.alignment_column_filter(df).collect()}
    assert got == {1: "ACG", 2: "ACG", 3: "-CG"}


def test_template_and_errors(spark):
    refs = spark.createDataFrame([(1, "ACGTACGTTT"), (2, "GGGGCCCCAA")], "ref_id long, seq string")
    q = spark.createDataFrame([(7, "ACGTACGTTA", 3), (8, "GGGGCCCCAA", 2), (9, "TTTTTTTTTT", 1)], "seq_id long, seq string, n long")
    best = {r["seq_id"]: r["ref_id"] for r in Q.template_search(q, refs, k=4).collect()}
    assert best == {7: 1, 8: 2}


def test_fewest_mismatches_over_all_references(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("ACGTé") for _ in range(n))
    refs = [make(rng.randrange(1, 30)) for _ in range(25)]
    texts = ["", refs[0], refs[1] + "ACGT", "T" * 60] + [make(rng.randrange(1, 40)) for _ in range(60)]
    want = {
        i: min(sum(x != y for x, y in zip(t, r)) + abs(len(t) - len(r)) for r in refs) for i, t in enumerate(texts)
    }
    r = spark.createDataFrame([*enumerate(refs), (99, None)], "ref_id long, seq string")
    q = frame(spark, texts, {i: i % 4 + 1 for i in want})
    for block in (1 << 24, 600):  # one block, and many
        got = Q.fewest_mismatches(q, r, block).collect()
        assert len(got) == len(texts) and {x["seq_id"]: x["errors"] for x in got} == want
    hist = {x["errors"]: x["sequences"] for x in Q.reference_error_histogram(q, r).collect()}
    assert sum(hist.values()) == sum(i % 4 + 1 for i in want)
    assert {x["errors"] for x in Q.fewest_mismatches(q, r.limit(0)).collect()} == {None}


def test_classifier_bootstrap_is_confident_on_clear_input(spark):
    rng = random.Random(5)
    make = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(80))
    train = spark.createDataFrame(
        [(i, "ab"[i % 2], make("ACG" if i % 2 == 0 else "CGT")) for i in range(40)], "seq_id long, taxon string, seq string"
    )
    q = spark.createDataFrame([(1, make("ACG")), (2, make("CGT")), (3, "NNNNNNNN")], "seq_id long, seq string")
    got = {r["seq_id"]: r["taxon"] for r in Q.nb_classify(q, train, k=3).collect()}
    assert got[1] == "a" and got[2] == "b" and got[3] == "a"
    lineages = spark.createDataFrame([("a", ["root", "a"]), ("b", ["root", "b"])], "taxon string, ranks array<string>")
    rows = Q.nb_bootstrap(q.where("seq_id < 3"), train, lineages, k=3, iters=20).collect()
    assert all(r["conf"] == 100 for r in rows if r["rank"] == 1)
    assert {(r["seq_id"], r["name"]) for r in rows if r["rank"] == 2} == {(1, "a"), (2, "b")}


def test_texts_without_a_word_or_hit_have_a_row(spark):
    train = spark.createDataFrame([(1, "a", "ACGTACGT"), (2, "b", "GGGGCCCC")], "seq_id long, taxon string, seq string")
    q = spark.createDataFrame([(1, "ACGTAC"), (2, "TTTTTT"), (3, "AC"), (4, ""), (5, None)], "seq_id long, seq string")
    refs = train.select(F.col("seq_id").alias("ref_id"), "seq")
    got = {r["seq_id"]: (r["ref_id"], r["shared"]) for r in Q.template_search(q, refs, k=4, all_queries=True).collect()}
    assert got == {1: (1, 3), 2: (None, 0), 3: (None, 0), 4: (None, 0), 5: (None, 0)}
    rows = {r["seq_id"]: r for r in Q.nb_classify(q, train, k=4, all_queries=True).collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and rows[1]["taxon"] == "a"
    assert all(rows[i]["taxon"] is None and rows[i]["score"] == 0 for i in (3, 4, 5))
    lineages = spark.createDataFrame([("a", ["root", "a"]), ("b", ["root", "b"])], "taxon string, ranks array<string>")
    boot = Q.nb_bootstrap(q, train, lineages, k=4, iters=30).collect()
    assert sorted((r["seq_id"], r["rank"]) for r in boot) == [(i, k) for i in range(1, 6) for k in (1, 2)]
    assert all((r["taxon"], r["name"], r["conf"]) == (None, "unclassified", 0) for r in boot if r["seq_id"] > 2)
    few = Q.nb_bootstrap(q, train, lineages, k=4, iters=1).collect()  # most words are not drawn
    assert sorted((r["seq_id"], r["rank"]) for r in few) == [(i, k) for i in range(1, 6) for k in (1, 2)]


def test_consensus_falls_back_to_the_parent(spark):
    df = spark.createDataFrame(
        [(1, 60, ["B", "F", "x"]), (1, 40, ["B", "G", "y"]), (2, 1, ["P", "Q", "r"]), (2, 1, ["S", "T", "u"])],
        "otu long, n long, ranks array<string>",
    )
    got = {r["otu"]: r["taxonomy"] for r in Q.consensus_taxonomy(df).collect()}
    assert got[1] == "B(100);F(60);x(60);"
    assert got[2] == "unclassified(100);unclassified(100);unclassified(100);"


def test_mcc_counts_pairs_without_listing_them(spark):
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3)], "seq_id long, cluster long")
    pairs = spark.createDataFrame([(0, 1, 0.01), (2, 3, 0.02)], "a long, b long, dist double")
    r = Q.cluster_mcc(pairs, clusters).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 2, 2)


def test_fastq_quality_may_start_with_at(spark, tmp_path):
    text = "".join(f"@r{i} extra\n{'ACGT' * (i + 1)}\n+\n{'@' if i % 2 else 'I'}{'#' * (4 * i + 3)}\n" for i in range(9))
    (tmp_path / "x.fastq").write_text(text)
    got = {r["seq_id"]: r for r in T.read_fastq(spark, str(tmp_path / "x.fastq")).collect()}
    assert len(got) == 9
    for i in range(9):
        assert got[f"r{i}"]["seq"] == "ACGT" * (i + 1)
        assert got[f"r{i}"]["qual"] == ("@" if i % 2 else "I") + "#" * (4 * i + 3)


def test_fastq_across_split_borders(spark, tmp_path):
    text = "".join(f"@r{i}\n{'ACGTACGT'}\n+\n@IIIIII{i % 10}\n" for i in range(3000))
    (tmp_path / "y.fastq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = T.read_fastq(spark, str(tmp_path / "y.fastq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["seq_id"]: r["qual"] for r in rows} == {f"r{i}": f"@IIIIII{i % 10}" for i in range(3000)}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("rows", [10_000, 7])
def test_fastq_keeps_empty_reads(spark, tmp_path, small_splits, rows):
    rng = random.Random(2)
    want = {}
    for f in range(3):
        out = []
        for i in range(400):
            n = rng.choice([0, 0, 1, 8, 30])
            seq, qual = "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+#I") for _ in range(n))
            want[f"r{f}_{i}"] = (seq, qual)
            out.append(f"@r{f}_{i} of file\n{seq}\n+x\n{qual}\n")
        text = "".join(out) + "\n\n" * (f == 1)
        if f == 2:
            text = text.replace("\n", "\r\n")
        (tmp_path / f"{f}.fastq").write_bytes(text.encode())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        found = T.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(want) and {r["seq_id"]: (r["seq"], r["qual"]) for r in found} == want


def test_malformed_fastq_is_an_error(spark, tmp_path):
    for i, text in enumerate(["@a\nAC\n+\nI\n", "a\nAC\n+\nII\n", "@a\nAC\nII\n+\n", "@a\nAC\n+\nII\n@b\nAC\n"]):
        (tmp_path / f"{i}.fastq").write_text(text)
        with pytest.raises(Exception, match="malformed FASTQ record at line"):
            T.read_fastq(spark, str(tmp_path / f"{i}.fastq")).collect()


def test_ranged_sheet_by_physical_rows(spark, tmp_path, small_splits):
    rows = [f'x{i}\ts{i}\t"{i}\t0"\t{i / 4}\textra' for i in range(500)]
    text = ["\ufefftitle", "", "note\tSample ID\tA b\t\tmore", "\t\tppm\tppm\t"] + rows + ["short", "footer\ta\tb\tc\td"]
    (tmp_path / "a.tsv").write_text("\n".join(text[:200]) + "\n")
    (tmp_path / "b.tsv").write_text("\n".join(text[200:]) + "\n")
    got = T.read_ranged_sheet(spark, str(tmp_path), header_row=3, last_row=505, first_col=2, last_col=4)
    assert got.columns == ["Sample ID", "A b", "...4"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(f"s{i}", f"{i}\t0", str(i / 4)) for i in range(500)] + [(None, None, None)], key=str
    )
    numbers = {r["value"]: r["line_no"] for r in T.numbered_lines(spark, str(tmp_path), per_file=False)[0].collect() if r["value"]}
    assert all(numbers[x] == i for i, x in enumerate(text) if x and i)
    with pytest.raises(ValueError):
        T.read_ranged_sheet(spark, str(tmp_path), header_row=9999)


def test_fasta_joins_wrapped_lines(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a desc\nACGT\nAC\n>b\nTT\n")
    got = {r["seq_id"]: r["seq"] for r in T.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert got == {"a": "ACGTAC", "b": "TT"}


def test_bootstrap_votes_against_plain_scores(spark):
    import hashlib
    import math

    rng = random.Random(3)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    train = [(i, "abc"[i % 3], make(("ACG", "CGT", "AGTé")[i % 3], rng.randrange(0, 60))) for i in range(60)] + [(99, "c", None)]
    queries = [(i, make(("ACG", "CGT", "AGTé", "ACGTé")[i % 4], rng.randrange(0, 30))) for i in range(24)] + [(99, None)]
    k, iters = 3, 40
    words = lambda t: {t[i : i + k] for i in range(len(t or "") - k + 1)}
    seen = {}
    for _, x, t in train:
        for w in words(t):
            seen.setdefault(w, {}).setdefault(x, 0)
            seen[w][x] += 1
    size = {x: sum(y == x for _, y, _ in train) for x in "abc"}
    prior = lambda w: (sum(seen.get(w, {}).values()) + 0.5) / (len(train) + 1)

    def best(ws):
        score = lambda x: math.fsum(math.log((seen.get(w, {}).get(x, 0) + prior(w)) / (size[x] + 1)) for w in ws)
        return max(sorted(size), key=score) if ws else None

    def chosen(w, i):
        return hashlib.md5(f"1-{i // 32}-{w}".encode()).hexdigest()[i % 32] in "01"

    ranks = {x: ["root", "ab" if x in "ab" else "c", x] for x in "abc"}
    want = {}
    for q, t in queries:
        own = words(t)
        votes = [v for v in (best({w for w in own if chosen(w, i)}) for i in range(iters)) if v]
        full = best(own)
        for r in (1, 2, 3):
            same = sum(ranks[v][:r] == ranks[full][:r] for v in votes) if full else 0
            conf = 100 * same / len(votes) if votes else 0.0
            want[q, r] = (full, ranks[full][r - 1] if conf >= 80 else "unclassified", conf)
    t = spark.createDataFrame(train, "seq_id long, taxon string, seq string")
    q = spark.createDataFrame(queries, "seq_id long, seq string")
    lineages = spark.createDataFrame([(x, r) for x, r in ranks.items()], "taxon string, ranks array<string>")
    for bound in (Q.BROADCAST_BYTES, 10):  # vocabulary broadcast, and joined
        old, Q.BROADCAST_BYTES = Q.BROADCAST_BYTES, bound
        try:
            rows = Q.nb_bootstrap(q, t, lineages, k=k, iters=iters).collect()
        finally:
            Q.BROADCAST_BYTES = old
        got = {(r["seq_id"], r["rank"]): (r["taxon"], r["name"], r["conf"]) for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        for key, (taxon, name, conf) in want.items():
            assert got[key][:2] == (taxon, name) and got[key][2] == pytest.approx(conf)
    assert {r["taxon"] for r in Q.nb_bootstrap(q, t.limit(0), lineages, k=k, iters=5).collect()} == {None}


@pytest.mark.parametrize("letters", ["ACGé", "".join(map(chr, range(0x4E00, 0x4E00 + 300))), "A"])
def test_classifier_against_plain_scores(spark, monkeypatch, letters):
    import math

    rng, k = random.Random(8), 8 if len(letters) > 9 else 3
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(12)]
    make = lambda own: "".join(rng.choice(own) for _ in range(rng.randrange(0, 9)))
    train = [(i % 55, ("a", "b", "c", None)[min(i % 4, rng.randrange(9))], make(pieces[i % 4 :])) for i in range(60)]
    train += [(100, "d", None), (101, "a", ""), (102, "b", "A\n"), (103, None, None)]
    queries = [(i % 28, make(pieces) + rng.choice(["", "漢", "😀" * 9])) for i in range(30)] + [(98, "A"), (99, None)]
    words = lambda t: {t[i : i + k] for i in range(len(t or "") - k + 1)}
    seen, size = {}, {}
    for _, x, t in train:
        size[x] = size.get(x, 0) + 1
        for w in words(t):
            seen.setdefault(w, {}).setdefault(x, 0)
            seen[w][x] += 1
    low = min(size, key=lambda x: (size[x], x is not None, x))

    def scores(texts):
        own = [(w, seen.get(w, {})) for t in texts for w in words(t)]
        free, n, gain = [], 0, {}
        for _, c in own:
            pw = (sum(c.values()) + 0.5) / (len(train) + 1)
            named = {x: v for x, v in c.items() if x is not None}
            # a word without a class, also one of a text without a class, counts as not seen
            parts = [math.log(pw)] * bool(named) + [math.log(0.5 / (len(train) + 1))] * (None in c or not c)
            free, n = free + parts, n + len(parts)
            for x, v in named.items():
                gain.setdefault(x, []).append(math.log((v + pw) / pw))
        gain.setdefault(low, [])
        return {x: math.fsum([*free, *g]) - n * math.log(size[x] + 1) for x, g in gain.items()} if own else {None: 0.0}

    monkeypatch.setattr(W, "_BATCH_WORDS", 40)
    monkeypatch.setattr(W, "_BATCH_CELLS", 20)
    monkeypatch.setattr(W, "_BUCKET_WORDS", 50)
    t = spark.createDataFrame(train, "seq_id long, taxon string, seq string")
    q = spark.createDataFrame(queries, "seq_id long, seq string")
    for a, b, rows in ((q, t, queries), (t, t, [(i, x) for i, _, x in train])):
        got = Q.nb_classify(a, b, k=k, all_queries=True).collect()
        assert sorted(r["seq_id"] for r in got) == sorted({i for i, _ in rows})
        for r in got:
            want = scores([x for i, x in rows if i == r["seq_id"]])
            assert r["score"] == pytest.approx(max(want.values())) and want[r["taxon"]] == pytest.approx(r["score"])
    some = {i for i, x in queries if words(x)}
    assert {r["seq_id"] for r in Q.nb_classify(q, t, k=k).collect()} == some


def test_classifier_has_no_row_per_word(spark):
    rng = random.Random(9)
    t = spark.createDataFrame([(i, "ab"[i % 2], "".join(rng.choices("ACGT", k=3000))) for i in range(40)], "seq_id long, taxon string, seq string")
    plan = Q.nb_classify(t, t, k=8, all_queries=True)._jdf.queryExecution().toString()
    assert "Generate" not in plan
    texts = t.selectExpr("seq_id", "true AS asked", "CASE taxon WHEN 'a' THEN 0 ELSE 1 END AS class", "seq")
    assert W.class_sums(texts, 8, 2, -1, 40).count() == 3 * 40


def test_words_are_told_apart_where_high_bits_agree():
    import numpy as np

    lanes = [np.array([5, 7, 5, 6, 7, 5], np.uint64)]
    assert W._order(lanes).tolist() == [0, 2, 5, 3, 1, 4]
    table = [np.array([1, 1, 2], np.uint64), np.array([3, 4, 0], np.uint64)]
    assert W._find(table, [np.array([1, 2, 1, 2], np.uint64), np.array([4, 1, 3, 0], np.uint64)]).tolist() == [1, -1, 0, 2]


@pytest.mark.parametrize("k,letters", [(3, 5), (8, 105), (12, 300)])
def test_moved_words_come_back_and_are_small(k, letters):
    rng = np.random.default_rng(3)
    x = (rng.integers(0, 6, 30_000) ** 2 % letters).astype(np.uint64)
    lanes = W._lanes(x, k, letters)
    assert (W._unmixed(lanes) == W._unmixed([lane[::-1] for lane in lanes])[::-1]).all()
    order = np.lexsort(lanes[::-1])
    lanes = [lane[order] for lane in lanes]
    lanes = [lane[W._starts(lanes)] for lane in lanes]
    held = rng.integers(1, 4, len(lanes[0])).astype(np.uint16)
    texts = rng.integers(0, 900, int(held.sum())).astype(np.uint16)
    small = W._written_small(lanes, held, texts)
    back = W._read_small(*map(pa.py_buffer, small), len(lanes))
    assert all((a == b).all() for a, b in zip(back[0], lanes)) and (back[1] == held).all() and (back[2] == texts).all()
    whole = sum(len(a) * a.itemsize for a in (*lanes, held, texts))
    assert sum(map(len, small)) < 0.75 * whole or len(held) < 1000
    none = W._written_small([lane[:0] for lane in lanes], held[:0], texts[:0])
    assert len(W._read_small(*map(pa.py_buffer, none), len(lanes))[1]) == 0
