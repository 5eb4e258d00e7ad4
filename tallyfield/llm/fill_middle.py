"""Fill-in-middle by displacement: every byte of a batch is moved once, to its place in the transformed texts.

A batch is one array of UTF-8 bytes. A scan of the bytes that begin a code point turns cuts into byte places. How far a
byte moves changes only at the start of a prefix, middle or suffix, so the changes are written into a difference
array, its cumulative sum is the shift of every byte, and one scatter builds all outputs. Back, the marks in the output
give the segments, the same sums give where every byte of the texts stands in it, and one gather restores them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Of 100 documents about so many stay plain, and of 100 others about so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
_LETTERS = np.frombuffer(b"PSM", np.uint8)
_MARK_BYTES = np.frombuffer(b"<P><S><M>", np.uint8).reshape(3, 3)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the place where each starts, with the end at last; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, at - at[0]


def texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A column of texts from their bytes and places; the reverse of ``raw``."""
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def find_marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, letter (0 to 2 for P, S, M) and place of every mark that lies within one text, in order."""
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    place = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    letter = np.full(256, -1)
    letter[_LETTERS] = np.arange(3)
    kind = letter[data[place + 1]]
    row = np.searchsorted(at, place, "right") - 1
    whole = (kind >= 0) & (place + 3 <= at[row + 1])
    return row[whole], kind[whole], place[whole]


def shifts(starts: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """How far each of ``n`` bytes moves, if from ``starts[i]`` (ascending) on it is ``moves[i]``; the last of equal starts holds."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, np.diff(moves, prepend=0))
    return np.cumsum(change[:n])


def draws(ids: list, salt: str) -> np.ndarray:
    """Four unsigned 32-bit numbers per id, from the SHA-256 of the salt and the decimal id; a null id is no digits."""
    one = (hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(b"".join(one), ">u4").reshape(-1, 4).astype(np.int64)


def transform(data: np.ndarray, at: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """Lengths, form (0 plain, 1 prefix first, 2 suffix first), cuts in code points, and the bytes of all outputs."""
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(leads, at)
    n = np.diff(first)
    form = np.where(h[:, 3] % 100 < SUFFIX_FIRST, 2, 1)
    form[(n == 0) | (h[:, 2] % 100 >= 100 - PLAIN)] = 0
    form[find_marks(data, at)[0]] = 0
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts[form == 0] = n[form == 0][:, None]
    a, b = leads[first[:-1] + cuts[:, 0]], leads[first[:-1] + cuts[:, 1]]
    prefix, suffix = a - at[:-1], at[1:] - b
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + 9 * (form > 0))])
    start, late = out_at[:-1], form == 2
    to_prefix = start + np.where(late, 6 + suffix, 3 * (form > 0))
    to_suffix = start + np.where(late, 3, 6 + prefix)
    to_middle = start + 9 + prefix + suffix
    moves = np.stack([to_prefix - at[:-1], to_middle - a, to_suffix - b], 1)
    moves[form == 0] = moves[form == 0][:, :1]
    out = np.empty(out_at[-1], np.uint8)
    out[np.arange(len(data)) + shifts(np.stack([at[:-1], a, b], 1).ravel(), moves.ravel(), len(data))] = data
    marks = np.stack([to_prefix - 3, to_suffix - 3, to_middle - 3], 1)[form > 0]
    out[marks[:, :, None] + np.arange(3)] = _MARK_BYTES
    return {"n": n, "form": form, "prefix": cuts[:, 0], "middle": cuts[:, 1] - cuts[:, 0], "data": out, "at": out_at}


def restore(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and places of the texts that ``transform`` took, from its outputs and forms alone."""
    row, kind, place = find_marks(data, at)
    start, end = np.repeat(at[:-1, None], 3, 1), np.repeat(at[1:, None], 3, 1)  # of prefix, suffix, middle
    ours = form[row] > 0
    start[row[ours], kind[ours]] = place[ours] + 3
    first, second, third = start[:, 0], start[:, 1], start[:, 2]
    end[:, 0] = np.where(form == 0, at[1:], np.where(form == 2, third, second) - 3)
    end[:, 1] = np.where(form == 2, first, third) - 3
    start[form == 0, 1:] = end[form == 0, 1:] = at[1:][form == 0][:, None]
    start, end = start[:, [0, 2, 1]], end[:, [0, 2, 1]]  # in the order of the text
    ends = np.concatenate([[0], np.cumsum((end - start).ravel())])
    total = int(ends[-1])
    return data[np.arange(total) + shifts(ends[:-1], start.ravel() - ends[:-1], total)], ends[::3]


FORMS = ["plain", "psm", "spm"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row, in one pass without a shuffle.

    ``n`` counts code points; cuts and form follow from the id alone. Null text is empty and, as texts that hold a
    mark, plain; the two lengths are null there. A null id draws as an empty string; repeated rows give equal rows.
    Memory follows the Arrow batch and ``common.CHUNK``, or the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            out = transform(*raw(b.column(1)), draws(b.column(0).to_pylist(), salt))
            plain = out["form"] == 0
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(out["n"], pa.int64()), pa.array([FORMS[f] for f in out["form"]], pa.string()),
                    pa.array(out["prefix"], pa.int64(), mask=plain), pa.array(out["middle"], pa.int64(), mask=plain),
                    texts(out["data"], out["at"]),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``made`` with the texts rebuilt from output and form, in one pass; a null output or form gives the output as it is.

    ``name`` takes the place of a column of that name.
    """
    kept = [c for c in made.columns if c != name]
    text, form = kept.index(output_col), kept.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, text):
            forms = np.array([FORMS.index(f) if f in FORMS else 0 for f in b.column(form).to_pylist()], np.int64)
            back = texts(*restore(*raw(b.column(text)), forms))
            yield pa.RecordBatch.from_arrays([*b.columns, back], names=[*kept, name])

    made = made.select(kept)
    return made.mapInArrow(run, made.withColumn(name, F.lit("")).schema)
