"""Fill-in-middle against plain slicing of code points, and its exact round trip."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import fill_middle as M
from tallyfield.llm import common, queries


def brute(doc_id, text):
    text = text or ""
    hexa = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "a", "é", "<P>", "a<P", "<", ">", "<S", "S>", "P>x<", "x<M>y", "漢字😀" * 7, "<<<>>>", "a\0b\nc ", "‏é́", "<P ><Q>"]


def columns(texts):
    data = [(t or "").encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), at


def cut(data, at):
    return [data[s:e].tobytes().decode() for s, e in zip(at, at[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("<>PSMab é漢😀\n"), max_size=12), max_size=9), st.integers(0, 10**6))
def test_batches(texts, first):
    ids = [first + i for i in range(len(texts))]
    data, at = columns(texts)
    got = M.transform(data, at, M.draws(ids, "1:"))
    want = [brute(i, t) for i, t in zip(ids, texts)]
    assert cut(got["data"], got["at"]) == [w[4] for w in want]
    assert [M.FORMS[f] for f in got["form"]] == [w[1] for w in want]
    assert got["n"].tolist() == [w[0] for w in want]
    back = M.restore(got["data"], got["at"], got["form"])
    assert cut(*back) == texts


def test_rows(frame, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 50)
    texts = [*ODD, *ODD, "x" * 200_000 + "é" * 1000, "same text", "same text"]
    ids = [*range(len(texts) - 2), 77, 77]
    ids[3] = None
    rows = M.restored(M.fill_in_middle(frame(texts, ids)), name="restored").collect()
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"] or -1, r["middle_chars"] or -1, r["output"], r["restored"]) for r in rows)
    want = sorted(
        (str(i), w[0], w[1], w[2] or -1, w[3] or -1, w[4], t or "") for i, t in zip(ids, texts) for w in [brute(i, t)]
    )
    assert got == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert M.restored(M.fill_in_middle(frame([]))).collect() == []


def test_restored_keeps_columns(spark):
    made = spark.createDataFrame([("<P>a<S>c<M>b", "psm", 1, None), ("x", "plain", 2, "y"), (None, None, 3, "")], "output string, form string, n int, restored string")
    rows = M.restored(made).orderBy("n").collect()
    assert rows[0].asDict() == {"output": "<P>a<S>c<M>b", "form": "psm", "n": 1, "restored": "abc"}
    assert [r["restored"] for r in rows] == ["abc", "x", ""]


def test_query(spark, data):
    rows = queries.op11_fill_middle(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        n, form, p, m, out = brute(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(out), sha(texts[r["doc_id"]] or ""))
