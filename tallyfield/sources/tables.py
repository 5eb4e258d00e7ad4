"""Scans and sinks for delimited tables, manifests, ranged sheets and sequence records."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import syntactic_name
from ..session import BROADCAST_BYTES, checkpointed

MANIFEST_SCHEMA = "group string, r1 string, r2 string"


def read_tsv(spark: SparkSession, path: str | list[str], schema: str | StructType, header: bool = True) -> DataFrame:
    """Tab-separated table with a declared schema."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Comma-separated table with a header; a leading byte-order mark is ignored."""
    return spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless sample manifest: group, forward file, reverse file."""
    return read_tsv(spark, path, MANIFEST_SCHEMA, header=False)


def repair_names(df: DataFrame) -> DataFrame:
    """Syntactic column names, made unique by a numeric suffix."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        fixed = syntactic_name(c)
        k = seen.get(fixed, 0)
        seen[fixed] = k + 1
        names.append(fixed if k == 0 else f"{fixed}.{k}")
    return df.toDF(*names)


def numbered_lines(spark: SparkSession, path: str | list[str], per_file: bool = True) -> tuple[DataFrame, bool]:
    """``(file, line_no, value)``: the lines of text files with their physical number from 0, and whether they are in order.

    Files are read in splits. A first pass counts the lines of every file block; running sums over the blocks, one row
    each, give the number of a block's first line, and in the second pass a line adds its place in the block. Without
    ``per_file`` the files are numbered through in the order of their names. In order means that every partition holds
    stretches of a file as they are in it, which is so unless the blocks are too many for a broadcast.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", r"\r\z", "").alias("value"),
    )
    blocks = checkpointed(raw.groupBy("file", "block").agg(F.min("row").alias("low"), F.count("*").alias("n")))
    before = (Window.partitionBy("file") if per_file else Window.partitionBy(F.lit(0))).orderBy("file", "block")
    first = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("file", "block", (first - F.col("low")).alias("shift"))
    small = blocks.count() * 256 <= BROADCAST_BYTES
    lines = raw.join(F.broadcast(shift) if small else shift, ["file", "block"])
    return lines.select("file", (F.col("row") + F.col("shift")).alias("line_no"), "value"), small


def read_ranged_sheet(
    spark: SparkSession, path: str, header_row: int, last_row: int | None = None, first_col: int = 1,
    last_col: int | None = None, units_row: bool = True, sep: str = "\t",
) -> DataFrame:
    """A cell range of a delimited sheet export by its physical rows and columns, counted from 1.

    Column names come from ``header_row``; a blank one is named by its place. The row of units below is left out, as are the
    rows after ``last_row``. An export of several files is one sheet in the order of their names. A row that is too
    short ends in NULLs. Values stay text; cast with ``as_numeric``.
    """
    lines, _ = numbered_lines(spark, path, per_file=False)
    head = lines.where(F.col("line_no") == header_row - 1).select("value").first()  # one row
    if head is None:
        raise ValueError(f"the sheet has no row {header_row}")
    names = next(csv.reader([head["value"].removeprefix("\ufeff")], delimiter=sep), [])
    wanted = range(first_col - 1, len(names) if last_col is None else min(last_col, len(names)))
    below = F.col("line_no") >= header_row + (1 if units_row else 0)
    rows = lines.where(below if last_row is None else below & (F.col("line_no") < last_row))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = rows.select(F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE"}).alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(names[i] or f"...{i + 1}") for i in wanted])


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA records: one row per record, wrapped sequence lines joined, either line ending.

    Input is cut at ``\\n>``, so a ``>`` inside a header is text; the file's first record still has its own.
    """
    text = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split(F.regexp_replace("value", r"\A>|\r", ""), "\n")
    seq = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "")
    return text.select(
        F.regexp_extract(F.element_at(parts, 1), r"^(\S+)", 1).alias("seq_id"), seq.alias("seq")
    ).withColumn("length", F.length("seq"))


_FASTQ = "seq_id string, seq string, qual string, file string, line_no long, value string"


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose four lines follow each other; the lines of others as they are."""
    names = [c.split()[0] for c in _FASTQ.split(", ")]

    def emit(t: pa.RecordBatch, whole: np.ndarray, loose: np.ndarray) -> pa.RecordBatch:
        value, n, m = t.column(2), len(whole), len(loose)
        none = lambda k: pa.nulls(k, pa.string())
        at = pa.array(whole)
        parts = [
            [value.take(pa.array(whole + k)).cast(pa.string()) for k in (0, 1, 3)] + [t.column(0).take(at).cast(pa.string()), t.column(1).take(at), value.take(pa.array(whole + 2)).cast(pa.string())],
            [none(m)] * 3 + [t.column(0).take(pa.array(loose)).cast(pa.string()), t.column(1).take(pa.array(loose)), value.take(pa.array(loose)).cast(pa.string())],
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(*parts)], names=names)

    def split(t: pa.RecordBatch, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """First lines of whole records, other lines, and the line from which on the next batch is needed."""
        no = t.column(1).to_numpy()
        n = len(no)
        new_file = np.zeros(n, bool)
        if n:
            code = t.column(0).dictionary_encode().indices.to_numpy()
            new_file[1:] = np.diff(code) != 0
        run = np.cumsum(new_file | (np.diff(no, prepend=no[:1] - 1) != 1))  # stretches of following lines
        first = np.flatnonzero(no % 4 == 0)
        inside = first[first + 3 < n]
        whole = inside[run[inside] == run[inside + 3]]
        keep = n
        if not last:
            start = n - 1
            while start >= 0 and n - start < 4 and no[start] % 4 != 0 and run[start] == run[n - 1]:
                start -= 1
            if n and start >= 0 and no[start] % 4 == 0 and run[start] == run[n - 1] and n - start < 4:
                keep = start
        used = np.zeros(n, bool)
        for k in range(4):
            used[whole + k] = True
        return whole, np.flatnonzero(~used[:keep]), keep

    rest: pa.RecordBatch | None = None
    for b in batches:
        t = b if rest is None or not rest.num_rows else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        whole, loose, keep = split(t, last=False)
        yield emit(t, whole, loose)
        rest = t.slice(keep)
    if rest is not None and rest.num_rows:
        whole, loose, _ = split(rest, last=True)
        yield emit(rest, whole, loose)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTQ records ``(seq_id, seq, qual)`` of four lines, read in parallel inside a file; empty reads are kept.

    Lines belong to records by their physical number, so what a line starts with doesn't matter. Records are put together
    where their lines are read; only those cut by the border of a file block are joined by their number. Blank lines
    at the end of a file are ignored. A record without its four lines, or whose marks or lengths are wrong, is an error.
    """
    lines, ordered = numbered_lines(spark, path)
    if not ordered:
        lines = lines.repartition("file", F.expr("line_no div 4")).sortWithinPartitions("file", "line_no")
    read = lines.mapInArrow(_whole_records, _FASTQ)
    loose = checkpointed(read.where("seq_id IS NULL").select("file", "line_no", "value"))  # up to six lines a block
    line = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    cut = loose.groupBy("file", F.expr("line_no div 4").alias("record")).agg(
        *[line(k).alias(c) for k, c in enumerate(("seq_id", "seq", "mark", "qual"))], F.max(F.length("value")).alias("_longest")
    ).where("_longest > 0").select("seq_id", "seq", "qual", "file", (F.col("record") * 4).alias("line_no"), "mark")
    whole = read.where("seq_id IS NOT NULL").withColumnRenamed("value", "mark").unionByName(cut)
    good = F.col("seq_id").startswith("@") & F.col("mark").startswith("+") & (F.length("seq") == F.length("qual"))
    where = F.concat(F.lit("malformed FASTQ record at line "), F.col("line_no") + 1, F.lit(" of "), F.col("file"))
    name = F.regexp_extract("seq_id", r"^@(\S*)", 1)
    return whole.select(
        F.when(F.coalesce(good, F.lit(False)), name).otherwise(F.raise_error(where)).alias("seq_id"), "seq", "qual"
    )


def read_many(spark: SparkSession, paths: str | list[str], schema: str | StructType, sep: str = "\t") -> DataFrame:
    """Several files as one table, with the name of the file each row came from."""
    df = spark.read.schema(schema).option("sep", sep).option("header", True).csv(paths)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("origin"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header, one per partition of ``df``."""
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq")).write.text(path)
