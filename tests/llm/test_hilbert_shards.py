"""Curve, cuts and file pruning."""

import itertools
import zlib

import numpy as np

from tallyfield.llm import hilbert_shards as H
from tallyfield.llm import queries


def test_curve_visits_all_cells_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = H.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_cuts_with_ties_nulls_and_repeats(frame):
    texts = ["same"] * 70 + [None, ""] + [f"t{i}" * i for i in range(40)] + ["x" * 50_000]
    ids = [5] * 30 + [None] * 3 + list(range(len(texts) - 33))
    df = frame(texts, ids=ids).select("doc_id", "lang", "source", "n_chars", "score")
    out = H.assign_shards(df, ["lang", "source", "n_chars"], "doc_id", 7)
    rows = out.collect()
    assert len(rows) == len(texts) and out.columns == [*df.columns, "hilbert", "shard", "slot"]
    check(rows, 7)
    order = [r["hilbert"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert H.assign_shards(df.limit(0), ["lang", "n_chars"], "doc_id", 7).collect() == []
    check(H.assign_shards(df.limit(3), ["lang", "n_chars"], "doc_id", 7).collect(), 7)


def test_strings_with_a_common_start_and_clashing_names(spark):
    rows = [(i, f"https://site{i % 20:02d}.org/é", None if i % 50 == 0 else "漢" * (i % 7), i % 13, -i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, rank string, shard_ long, hash int")
    out = H.assign_shards(df, ["source", "shard_"], "doc_id", 9)
    got = out.collect()
    check(got, 9)
    assert out.columns == [*df.columns, "hilbert", "shard", "slot"]
    assert sorted(tuple(r)[:5] for r in got if r["rank"]) == sorted(r for r in rows if r[2])
    # every site is a cell of its own in its dimension, so a filter on one leaves out most shards
    edges = H.cut_points(df, ["source", "shard_"], "doc_id", H.BITS)
    assert len(edges[0]) == 20
    ranges = H.shard_ranges(out, ["source"])
    found = [H.matching_shards(ranges, source=(x, x)).count() for x in ("https://site03.org/é", "https://site16.org/é")]
    assert max(found) < 6


def test_cut_points_come_from_all_rows(spark):
    # 60,000 rows: what a part of them shows, all rows need not
    df = spark.range(60_000).selectExpr("id AS doc_id", "IF(id % 7 = 0, null, format_string('%05d', id * 7919 % 60000)) AS source")
    values = sorted(f"{i * 7919 % 60000:05d}" for i in range(60_000) if i % 7)
    (edges,) = H.cut_points(df, ["source"], "doc_id", H.BITS)
    assert edges.tolist() == [values[int(q / 64 * len(values))] for q in range(1, 64)]


def test_query(spark, data):
    rows = queries.op3_hilbert_shards(spark, data).collect()
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    check(rows, 40)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 16, zlib.crc32(docs[r["doc_id"]])) for r in rows)


def test_files_and_pruning(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "n_chars")
    out = H.assign_shards(docs, ["lang", "n_chars"], "doc_id", 8)
    H.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()
    ranges = H.shard_ranges(out, ["lang", "n_chars"])
    picked = [r["shard"] for r in H.matching_shards(ranges, lang=("fr", "fr"), n_chars=(0, 500)).collect()]
    want = {r["shard"] for r in out.where("lang = 'fr' AND n_chars <= 500").collect()}
    assert want <= set(picked) and len(picked) < 8
