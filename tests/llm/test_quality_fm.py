"""The factorisation machine against the quadratic sum, and on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import quality_fm as Q
from tallyfield.llm import queries

ODD = [None, "", " \n\t", "a", "A!! " * 3000, "é" * 50_000, "x y\n" * 200, "same same", "same same"]


def slow_score(model, index, value):
    """Every pair of features on its own."""
    total = model.bias + sum(float(model.weight[i]) * float(x) for i, x in zip(index, value))
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            dot = float(np.dot(model.factor[index[a]].astype(float), model.factor[index[b]].astype(float)))
            total += dot * float(value[a]) * float(value[b])
    return 1 / (1 + np.exp(-total))


def small_model(seed=3):
    rng = np.random.default_rng(seed)
    return Q.Model(0.3, rng.normal(0, 1, Q.N_FEATURES).astype("f4"), rng.normal(0, 0.3, (Q.N_FEATURES, Q.RANK)).astype("f4"))


def test_identity_equals_all_pairs():
    model = small_model()
    rows = [Q.features(t.encode()) for t in ("", "one", "The quick brown fox. It jumps!\nover | the dog", "w " * 40 + "v u")]
    for (index, value), got in zip(rows, model.score(rows)):
        assert got == pytest.approx(slow_score(model, index, value), abs=1e-4)


def test_odd_rows(spark, frame):
    model = small_model()
    got = Q.score(frame(ODD, ids=[None, *range(1, len(ODD))]), model).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["score"] == by_id[8]["score"]
    assert by_id[None]["held_out"] is False
    assert frame([]).transform(lambda d: Q.score(d, model)).collect() == []
    kept = Q.keep_good(frame(ODD), model)
    assert kept.columns == frame(ODD).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in Q.score(frame(ODD), model).where("predicted = 1").collect()}


def test_no_labels_and_null_labels(spark, frame):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.score(frame(["a b", ""]), Q.train(frame(["a b", ""]), empty)).collect()} == {0.5}
    some = spark.createDataFrame([(0, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    Q.train(frame(["a b", "c d"]), some)


def test_held_out_labels(spark, data):
    scored = queries.op1_quality_fm(spark, data.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select("id", Q.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
