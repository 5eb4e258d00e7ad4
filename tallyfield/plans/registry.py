"""Named queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The analysis tables of ``proxies`` as SQL common table expressions.
CTE = {
    "samples": """samples AS (
        SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 2 = 0 THEN 'ctl' ELSE 'gos' END AS diet,
               CASE WHEN (s_suppkey // 2) % 2 = 0 THEN 'unc' ELSE 'sal' END AS challenge,
               CASE (s_suppkey // 4) % 4 WHEN 0 THEN 22 WHEN 1 THEN 24 WHEN 2 THEN 28 ELSE 35 END AS age,
               s_suppkey // 16 AS replicate,
               'l_' || CASE WHEN s_suppkey % 2 = 0 THEN 'ctl' ELSE 'gos' END || '_'
                 || CASE WHEN (s_suppkey // 2) % 2 = 0 THEN 'unc' ELSE 'sal' END || '_'
                 || CASE (s_suppkey // 4) % 4 WHEN 0 THEN 22 WHEN 1 THEN 24 WHEN 2 THEN 28 ELSE 35 END || '_'
                 || (s_suppkey // 16) AS name
        FROM supplier)""",
    "counts": """counts AS (
        SELECT l_suppkey AS sample, l_partkey AS feature, CAST(sum(l_quantity) AS BIGINT) AS reads
        FROM lineitem GROUP BY 1, 2)""",
    "genus": """genus AS (
        SELECT l_suppkey AS sample, p_brand AS feature, CAST(sum(l_quantity) AS BIGINT) AS reads
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "taxonomy": """taxonomy AS (
        SELECT p_partkey AS feature, p_type || '(100);' || p_brand || '(95);' || p_name || '(80);' AS taxonomy
        FROM part)""",
    "measures": """measures AS (
        SELECT o_orderkey AS unit, o_orderstatus AS stratum, o_orderpriority AS cohort, o_totalprice AS value
        FROM orders)""",
    "analytes": """analytes AS (
        SELECT user_id % (SELECT count(*) FROM supplier) AS sample, event_type AS analyte,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value
        FROM events GROUP BY 1, 2)""",
    "lines": """lines AS (
        SELECT doc_id, sample, pos, seq FROM (
          SELECT doc_id, source AS sample, unnest(range(0, len(string_split(text, chr(10))))) AS pos,
                 unnest(string_split(text, chr(10))) AS seq FROM documents) WHERE length(seq) > 0)""",
    "uniq": """uniq AS (
        SELECT md5(seq) AS seq_id, seq, count(*) AS n FROM (
          SELECT unnest(string_split(text, chr(10))) AS seq FROM documents) WHERE length(seq) > 0 GROUP BY seq)""",
    "refs": """refs AS (
        SELECT md5(seq) AS ref_id, seq FROM (
          SELECT unnest(string_split(text, chr(10))) AS seq FROM benchmark) WHERE length(seq) > 0 GROUP BY seq)""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in names)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
