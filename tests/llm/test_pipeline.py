"""The pipeline against plain versions of its stages, the same classifier given."""

import corpus_pipeline as C
from tallyfield.llm import quality_fm, queries

from .test_decontaminate import brute as hits
from .test_gray_simhash import components, slow_print
from .test_residual_packing import check
from .test_site_lines import brute as cut_lines


def test_run(spark, data):
    from tokenizers import Tokenizer

    data = data.replace("sf0.001", "sf0.01")  # with enough labels to reject anything
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality_fm.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = docs.orderBy("doc_id").collect()
    good = model.score([quality_fm.features(r["text"].encode()) for r in rows]) >= 0.3
    rows = [r for r, g in zip(rows, good) if g]
    ids = [r["doc_id"] for r in rows]
    texts = [t for t, *_ in cut_lines([r["text"] for r in rows], [r["source"] for r in rows], 0.1, 5)]
    groups = components([(i, slow_print(t)) for i, t in zip(ids, texts)])
    left = [(i, t) for (i, _, c), t in zip(groups, texts) if i == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {i: t for (i, t), h in zip(left, hits([t for _, t in left], items)) if not h[4]}
    assert 0 < len(clean) < len(left) < len(rows) < docs.count()
    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    used, least = check(C.run(spark, data).collect(), clean, tokenizer)
    assert used <= least + 2


def test_stages_keep_columns_and_bear_odd_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (5, "x y " * 30_000, None, "s", None)], docs.schema
    )
    for rows in (odd, odd.limit(0)):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, rows, data)
            assert out.columns == docs.columns and out.count() <= rows.count()
        assert C.STAGES[-1][1](spark, rows, data).count() >= rows.count()
