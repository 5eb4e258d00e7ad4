"""Ids and texts against the library on whole texts."""

import hashlib

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import piece_chunks as C
from tallyfield.llm import queries

PATH = queries.vocabulary("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "▁", "▁▁a", "a▁", "a▁ ▁b", "<s>", "</s> <unk>", "<0x0A>", "a\nb\r\n c", "\t\t x",
    "漢字仮名" * 40, "😀 é ﬁ Ａ    ", "x" * 3000, "the the the", "a\0b", "﻿the", "();\r\n  });\r",
]


def ids_of(table, texts):
    flat, counts = table.encode(pa.array(texts, pa.string()))
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@pytest.fixture(scope="module")
def table():
    with open(PATH, "rb") as f:
        return C.ChunkTable(f.read())


def test_odd_texts(table):
    assert ids_of(table, ODD) == SP.encode(ODD)
    assert ids_of(table, ODD) == SP.encode(ODD)  # from the table


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  ▁ab.\n\té漢"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text(table, texts):
    assert ids_of(table, texts) == SP.encode(texts)


def test_small_table(table, monkeypatch):
    monkeypatch.setattr(C, "TABLE_CHARS", 3)
    for some in (ODD, ODD[::-1], ["one two three four five six", "one two"]):
        assert ids_of(table, some) == SP.encode(some)


def test_a_vocabulary_that_normalises_is_refused():
    with open(PATH, "rb") as f:
        file = f.read()
    spaces = b"identity\x12\x00\x18\x01\x20"  # the next byte: remove extra white space
    assert file.count(spaces + b"\0") == 1
    with pytest.raises(ValueError, match="normalises"):
        C.ChunkTable(file.replace(spaces + b"\0", spaces + b"\1"))


def test_rows(frame):
    texts = [None, *ODD, "same", "same", "word " * 60_000]
    ids = [None, *range(len(texts) - 3), 5, 5]
    made = C.decode(C.encode(frame(texts, ids), PATH), PATH)
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in made.collect())
    assert got == sorted((str(i), SP.encode(t or ""), SP.decode(SP.encode(t or ""))) for i, t in zip(ids, texts))
    assert C.decode(C.encode(frame([]), PATH), PATH).collect() == []


def test_decode_keeps_columns(spark):
    df = spark.createDataFrame([(1, [264], "x"), (2, None, "y"), (3, [], None)], "n int, ids array<int>, decoded string")
    rows = C.decode(df, PATH).orderBy("n").collect()
    assert [(r["n"], r["ids"], r["decoded"]) for r in rows] == [(1, [264], "a"), (2, None, ""), (3, [], "")]


def test_query(spark, data):
    rows = queries.op13_piece_chunks(spark, data).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = SP.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(SP.decode(ids))
