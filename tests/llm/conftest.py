import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from texts; every case gets columns whose names clash with results and helpers."""

    def make(texts, ids=None, sources=None):
        ids = ids if ids is not None else list(range(len(texts)))
        rows = [
            (i, t, "en", (sources[k] if sources else f"src{k % 3}"), None if t is None else len(t), -1, 0.5, None, "x")
            for k, (i, t) in enumerate(zip(ids, texts))
        ]
        schema = TEXT_SCHEMA + ", score int, removed double, component_id string, fp string"
        return spark.createDataFrame(rows, schema)

    return make
