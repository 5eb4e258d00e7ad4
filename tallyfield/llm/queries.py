"""One query per operator over its whole table, with production parameters; SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_rules, decontaminate, fill_middle, gray_simhash, hilbert_shards, lloyd_codes, paragraph_dedup, piece_chunks,
    prefix_hash, quality_fm, residual_packing, site_lines, trie_counts,
)

SHARDS = 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the driver; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, folder, "labels")))


def op2_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return site_lines.drop_site_lines(docs, "source", "text").drop("source")


def op3_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return hilbert_shards.assign_shards(docs, ["lang", "source", "n_chars"], "doc_id", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def op4_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_dedup.find_repeats(table(spark, folder, "documents"))


def op5_trie_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = trie_counts.unigram_from_pieces(vocabulary("piece_bpe_32k.model"))
    return trie_counts.count_tokens(table(spark, folder, "documents"), model)


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    blocks = decontaminate.benchmark_blocks(table(spark, folder, "benchmark"))
    return decontaminate.contamination(table(spark, folder, "documents"), blocks)


def op7_residual_packing(spark: SparkSession, folder: str) -> DataFrame:
    return residual_packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op8_gray_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = gray_simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_block_rules(spark: SparkSession, folder: str) -> DataFrame:
    return block_rules.extract(table(spark, folder, "pages"))


def op10_prefix_hash(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_hash.document_fingerprints(table(spark, folder, "documents"))


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.fill_in_middle(table(spark, folder, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_lloyd_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = lloyd_codes.compress(table(spark, folder, "embeddings"))
    return lloyd_codes.label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(lloyd_codes.digest(books)).alias("codebooks_sha256"),
    )


def op13_piece_chunks(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    made = piece_chunks.decode(piece_chunks.encode(table(spark, folder, "documents"), model), model)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_fm, op2_site_lines, op3_hilbert_shards, op4_paragraph_dedup, op5_trie_counts, op6_decontaminate,
        op7_residual_packing, op8_gray_simhash, op9_block_rules, op10_prefix_hash, op11_fill_middle, op12_lloyd_codes,
        op13_piece_chunks,
    )
}

def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after the other, every part compared with every entry; vectors of a length the parts divide."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
        SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
               [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    cut AS MATERIALIZED (
        SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
        FROM kept, (SELECT unnest(range({parts})) AS p)),
    b0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM cut WHERE r <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
        SELECT r, p, x, min(struct_pack(d := d, k := k)) AS best
        FROM (SELECT r, cut.p, x, k, list_sum([CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT) FOR z IN list_zip(x, c)]) AS d
              FROM cut JOIN b{i} USING (p))
        GROUP BY r, p, x)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} AS MATERIALIZED (
        SELECT p, k, coalesce(new.c, b{i}.c) AS c
        FROM b{i} LEFT JOIN (
            SELECT p, k, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS c
            FROM (SELECT p, best.k AS k, j, sum(x[j]) AS s, count(*) AS n
                  FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY ALL)
            GROUP BY p, k) AS new USING (p, k))"""
            )
    last = rounds
    steps.append(
        f"""coded AS MATERIALIZED (
        SELECT r, string_agg(format('{{:02x}}', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
        FROM a{last} GROUP BY r),
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS h FROM b{last})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM coded JOIN kept USING (r), books"""
    )
    return ",\n    ".join(steps)


ORACLES: dict[str, str] = {
    "op12_lloyd_codes": _lloyd_sql(),
    "op11_fill_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
                   FROM documents),
        u AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
                     CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
                     CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                               OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        o AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM f)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM o""",
    "op2_site_lines": """
        WITH p AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        x AS (SELECT DISTINCT r, source, trim(l) AS l FROM (SELECT r, source, unnest(ls) AS l FROM p WHERE source IS NOT NULL)
              WHERE trim(l) <> ''),
        t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
        b AS (SELECT source, list(l) AS gone FROM (
                SELECT source, l FROM x JOIN t USING (source) GROUP BY source, l, total
                HAVING count(*) >= 5 AND CAST(count(*) AS DOUBLE) / CAST(total AS DOUBLE) > CAST(0.1 AS DOUBLE))
              GROUP BY source),
        k AS (SELECT doc_id, text, ls, [z FOR z IN ls IF NOT coalesce(list_contains(gone, trim(z)), false)] AS kept
              FROM p LEFT JOIN b USING (source))
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
               CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
        FROM k""",
}
