"""Sequence-collection queries: the texts at hand stand in for sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import seqs
from ..proxies import counts, lines, reference_lines, table, taxonomy, texts, unique_lines
from ..session import checkpointed
from .registry import CTE, query, with_tables

# measures of the whole document texts, by character position on the checking side
_DOC_FEATURES = """ch AS (SELECT doc_id, unnest(range(1, len(string_split(text, '')) + 1)) AS i,
             unnest(string_split(text, '')) AS c FROM documents),
    g AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM c AS brk FROM ch),
    h AS (SELECT doc_id, i, c, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
    hp AS (SELECT doc_id, max(k) AS homopolymer FROM (SELECT doc_id, run, count(*) AS k FROM h GROUP BY 1, 2) GROUP BY 1),
    ft AS (SELECT doc_id, count(*) AS length, count(*) FILTER (NOT regexp_matches(c, '[A-Za-z]')) AS ambig,
             coalesce(min(i) FILTER (c NOT IN (' ', '.')), 0) AS first_base,
             coalesce(max(i) FILTER (c NOT IN (' ', '.')), 0) AS last_base FROM ch GROUP BY 1)"""


def _doc_features(spark: SparkSession, d: str) -> DataFrame:
    return seqs.sequence_features(
        texts(spark, d).select("doc_id", "text"), "text", alphabet="A-Za-z", gaps=" ."
    )


@query(
    "sequence_scalars",
    f"""WITH {_DOC_FEATURES} SELECT doc_id, CAST(length AS INT) AS length, CAST(ambig AS INT) AS ambig,
        CAST(homopolymer AS INT) AS homopolymer, CAST(first_base AS INT) AS first_base,
        md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) AS revcomp_digest
        FROM documents JOIN ft USING (doc_id) JOIN hp USING (doc_id)""",
)
def sequence_scalars(spark: SparkSession, d: str) -> DataFrame:
    return _doc_features(spark, d).select(
        "doc_id", "length", "ambig", "homopolymer", "first_base",
        F.md5(S.reverse_complement(F.col("text"))).alias("revcomp_digest"),
    )


@query(
    "sequence_screen",
    f"""WITH {_DOC_FEATURES} SELECT doc_id, CAST(length AS INT) AS length FROM ft JOIN hp USING (doc_id)
        WHERE ambig <= 400 AND length <= 2000 AND homopolymer <= 8 AND first_base <= 1 AND last_base >= 50""",
)
def sequence_screen(spark: SparkSession, d: str) -> DataFrame:
    return seqs.screen(
        _doc_features(spark, d), max_ambig=400, max_length=2000, max_homop=8, start=1, end=50
    ).select("doc_id", "length")


@query(
    "paired_merge",
    """WITH t AS (SELECT concat_ws('-', conv_id, turn) AS seq_id, text, CAST(ceil(length(text) * 0.6) AS BIGINT) AS k
                  FROM conversations),
            r AS (SELECT seq_id, k, [CASE WHEN i % 17 = 0 THEN 'x' ELSE c END FOR c, i IN string_split(left(text, k), '')] AS f,
                    [CASE WHEN i % 23 = 0 THEN 'y' ELSE c END FOR c, i IN string_split(right(text, k), '')] AS b FROM t),
            o AS (SELECT seq_id, k, f, b, unnest(range(10, k + 1)) AS o FROM r),
            m AS (SELECT *, len(list_filter(range(1, o + 1), lambda i: f[k - o + i] <> b[i])) AS bad FROM o),
            w AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY bad / CAST(o AS DOUBLE), o DESC) AS rn FROM m
                  WHERE bad / CAST(o AS DOUBLE) <= 0.25)
       SELECT seq_id, CAST(o AS INT) AS overlap, CAST(bad AS INT) AS mismatches,
         array_to_string(f[1:k - o], '') || array_to_string(list_transform(range(1, o + 1), lambda i:
           CASE WHEN CASE WHEN i % 23 = 0 THEN 33 ELSE 70 END > CASE WHEN (k - o + i) % 17 = 0 THEN 35 ELSE 73 END
             THEN b[i] ELSE f[k - o + i] END), '') || array_to_string(b[o + 1:], '') AS seq
       FROM w WHERE rn = 1""",
)
def paired_merge(spark: SparkSession, d: str) -> DataFrame:
    # reads of the two ends of every message, sixty percent of it each, with wrong characters of low quality
    t = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("seq_id"), "text",
        F.ceil(F.length("text") * F.lit(0.6)).cast("int").alias("k"),
    )

    def read(part: str, every: int, wrong: str, low: str, high: str) -> DataFrame:
        seq = f"array_join(transform(split({part}(text, k), ''), (c, i) -> IF((i + 1) % {every} = 0, '{wrong}', c)), '')"
        qual = f"array_join(transform(sequence(1, k), i -> IF(i % {every} = 0, '{low}', '{high}')), '')"
        return t.select("seq_id", F.expr(seq).alias("seq"), F.expr(qual).alias("qual"))

    rev = read("right", 23, "y", "!", "F").select(
        "seq_id", S.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual")
    )
    return seqs.merge_pairs(read("left", 17, "x", "#", "I"), rev, min_overlap=10)


@query(
    "alignment_column_filter",
    with_tables("uniq")
    + """, ch AS (SELECT seq_id, length(seq) AS aln, unnest(range(0, len(string_split(seq, '')))) AS pos,
                    unnest(string_split(seq, '')) AS c FROM uniq),
         k AS (SELECT aln, pos FROM ch GROUP BY 1, 2
               HAVING NOT bool_or(c = '.') AND NOT bool_and(c IN (' ', '.')))
         SELECT aln, seq_id, coalesce(string_agg(c, '' ORDER BY pos) FILTER (k.pos IS NOT NULL), '') AS seq
         FROM ch LEFT JOIN k USING (aln, pos) GROUP BY 1, 2""",
)
def alignment_column_filter(spark: SparkSession, d: str) -> DataFrame:
    aligned = unique_lines(spark, d).select(F.length("seq").cast("long").alias("aln"), "seq_id", "seq")
    return seqs.alignment_column_filter(aligned, gap=" ", trump=".")


def _kmer_cte(name: str, source: str, key: str, text: str, extra: str = "") -> str:
    """Distinct 8-mers from character windows."""
    lead = " || ".join(["c"] + [f"lead(c, {j}) OVER w" for j in range(1, 8)])
    return f"""{name}_c AS (SELECT {key} AS id{extra}, unnest(range(0, len(string_split({text}, '')))) AS i,
             unnest(string_split({text}, '')) AS c FROM {source}),
        {name} AS (SELECT DISTINCT id{extra}, k FROM (SELECT id{extra}, {lead} AS k FROM {name}_c
             WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE k IS NOT NULL)"""


_BEST = """sh AS (SELECT q.id AS seq_id, r.id AS ref_id, count(*) AS shared FROM q JOIN r USING (k) GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY shared DESC, ref_id) AS rn FROM sh)
             WHERE rn = 1)"""


@query(
    "template_search",
    f"""WITH {_kmer_cte('q', 'documents', 'doc_id', 'text')}, {_kmer_cte('r', 'benchmark', 'item_id', 'text')},
        {_BEST} SELECT doc_id AS seq_id, ref_id, coalesce(shared, 0) AS shared
        FROM documents LEFT JOIN best ON seq_id = doc_id""",
)
def template_search(spark: SparkSession, d: str) -> DataFrame:
    q = texts(spark, d).select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    r = table(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("seq"))
    return seqs.template_search(q, r, k=8, all_queries=True)


@query(
    "reference_error_histogram",
    with_tables("uniq", "refs")
    + """, a AS (SELECT seq_id, unnest(range(0, len(string_split(seq, '')))) AS i, unnest(string_split(seq, '')) AS c FROM uniq),
         b AS (SELECT ref_id, unnest(range(0, len(string_split(seq, '')))) AS i, unnest(string_split(seq, '')) AS c FROM refs),
         m AS (SELECT seq_id, ref_id, count(*) AS same FROM a JOIN b USING (i, c) GROUP BY 1, 2),
         e AS (SELECT u.seq_id, any_value(u.n) AS n, min(greatest(length(u.seq), length(f.seq)) - coalesce(same, 0)) AS errors
               FROM uniq u CROSS JOIN refs f LEFT JOIN m ON m.seq_id = u.seq_id AND m.ref_id = f.ref_id GROUP BY 1)
         SELECT CAST(errors AS INT) AS errors, CAST(sum(n) AS BIGINT) AS sequences FROM e GROUP BY 1""",
)
def reference_error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return seqs.reference_error_histogram(unique_lines(spark, d), reference_lines(spark, d))


@query(
    "nb_classify",
    f"""WITH {_kmer_cte('q', 'documents', 'doc_id', 'text', ', lang')},
        n AS (SELECT count(*) AS n FROM documents), nk AS (SELECT lang AS taxon, count(*) AS nk FROM documents GROUP BY 1),
        wk AS (SELECT k, lang AS taxon, count(*) AS nwk FROM q GROUP BY 1, 2),
        pw AS (SELECT k, (sum(nwk) + 0.5) / (any_value(n) + 1) AS pw FROM wk, n GROUP BY 1),
        gain AS (SELECT wk.k, taxon, ln((nwk + pw) / pw) AS gain FROM wk JOIN pw USING (k)),
        base AS (SELECT id, sum(ln(pw)) AS flat, count(*) AS nq FROM q JOIN pw USING (k) GROUP BY 1),
        g AS (SELECT id, taxon, sum(gain) AS g FROM q JOIN gain USING (k) GROUP BY 1, 2),
        s AS (SELECT base.id, nk.taxon, flat + coalesce(g, 0) - nq * ln(nk + 1) AS score
              FROM base CROSS JOIN nk LEFT JOIN g ON g.id = base.id AND g.taxon = nk.taxon)
        SELECT doc_id AS seq_id, taxon, coalesce(round(score, 3), 0) AS score FROM documents LEFT JOIN (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, taxon) AS rn FROM s) ON id = doc_id AND rn = 1
        WHERE coalesce(rn, 1) = 1""",
)
def nb_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d).select(
        F.col("doc_id").alias("seq_id"), F.col("lang").alias("taxon"), F.col("text").alias("seq")
    )
    found = seqs.nb_classify(docs, docs, k=8, all_queries=True)
    return found.withColumn("score", F.round("score", 3))


@query(
    "nb_bootstrap",
    f"""WITH {_kmer_cte('q', 'documents', 'doc_id', 'text', ', lang')}, {_kmer_cte('b', 'benchmark', 'item_id', 'text')},
        bw AS (SELECT DISTINCT k FROM b), n AS (SELECT count(*) AS n FROM documents),
        nk AS (SELECT lang AS taxon, count(*) AS nk FROM documents GROUP BY 1),
        wk AS (SELECT k, lang AS taxon, count(*) AS nwk FROM q SEMI JOIN bw USING (k) GROUP BY 1, 2),
        pw AS (SELECT k, (coalesce(sum(nwk), 0) + 0.5) / (any_value(n) + 1) AS pw FROM bw CROSS JOIN n LEFT JOIN wk USING (k) GROUP BY 1),
        gain AS (SELECT wk.k, taxon, ln((nwk + pw) / pw) AS gain FROM wk JOIN pw USING (k)),
        dr AS (SELECT k, i FROM bw, range(0, 100) t(i)
               WHERE substr(md5('1-' || (i // 32) || '-' || k), CAST(i % 32 + 1 AS INT), 1) IN ('0', '1')
               UNION ALL SELECT k, -1 FROM bw),
        x AS (SELECT b.id, i, k FROM b JOIN dr USING (k)),
        base AS (SELECT id, i, sum(ln(pw)) AS flat, count(*) AS nq FROM x JOIN pw USING (k) GROUP BY 1, 2),
        g AS (SELECT id, i, taxon, sum(gain) AS g FROM x JOIN gain USING (k) GROUP BY 1, 2, 3),
        s AS (SELECT base.id, base.i, nk.taxon, flat + coalesce(g, 0) - nq * ln(nk + 1) AS score
              FROM base CROSS JOIN nk LEFT JOIN g ON g.id = base.id AND g.i = base.i AND g.taxon = nk.taxon),
        top AS (SELECT id, i, taxon FROM (
                  SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY score DESC, taxon) AS rn FROM s) WHERE rn = 1),
        lin AS (SELECT taxon, ['text', CASE WHEN taxon IN ('en', 'de') THEN 'germanic' ELSE 'romance' END, taxon] AS ranks FROM nk),
        f AS (SELECT id, taxon, ranks, unnest([1, 2, 3]) AS rank FROM top JOIN lin USING (taxon) WHERE i = -1),
        c AS (SELECT f.id, f.taxon, f.rank, any_value(f.ranks) AS ranks,
                coalesce(100 * count(*) FILTER (l.ranks[1:f.rank] = f.ranks[1:f.rank]) / nullif(count(l.taxon), 0), 0.0) AS conf
              FROM f LEFT JOIN top d ON d.id = f.id AND d.i >= 0 LEFT JOIN lin l ON l.taxon = d.taxon GROUP BY 1, 2, 3)
        SELECT item_id AS seq_id, c.taxon, r.rank, CASE WHEN conf >= 80 THEN c.ranks[r.rank] ELSE 'unclassified' END AS name,
          coalesce(conf, 0.0) AS conf
        FROM (SELECT item_id, unnest([1, 2, 3]) AS rank FROM benchmark) r LEFT JOIN c ON c.id = item_id AND c.rank = r.rank""",
)
def nb_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d).select(
        F.col("doc_id").alias("seq_id"), F.col("lang").alias("taxon"), F.col("text").alias("seq")
    )
    family = F.when(F.col("taxon").isin("en", "de"), "germanic").otherwise("romance")
    lineages = docs.select("taxon").distinct().withColumn("ranks", F.array(F.lit("text"), family, F.col("taxon")))
    messages = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq"))
    return seqs.nb_bootstrap(messages, docs, lineages, k=8, iters=100, cutoff=80)


# ---------------------------------------------------------------- distances and clusters


def _pairs_cte(cutoff: float, name: str = "pairs") -> str:
    return f"""{name} AS (SELECT * FROM (
        SELECT a.seq_id AS a, b.seq_id AS b, length(a.seq) AS len,
          list_sum(list_transform(range(1, length(a.seq) + 1),
            lambda i: CASE WHEN substr(a.seq, i, 1) <> substr(b.seq, i, 1) THEN 1 ELSE 0 END)) AS diffs
        FROM uniq a JOIN uniq b ON length(a.seq) = length(b.seq) AND a.seq_id < b.seq_id)
      WHERE diffs <= floor(len * {cutoff} + 1e-9))"""


@query(
    "threshold_distance_pairs",
    with_tables("uniq") + f", {_pairs_cte(0.1)} SELECT a, b, round(diffs / len, 6) AS dist FROM pairs",
)
def threshold_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return seqs.threshold_pairs(unique_lines(spark, d), 0.1).select("a", "b", F.round("dist", 6).alias("dist"))


_COMPONENTS = """nb AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
    reach(u, v) AS (SELECT seq_id, seq_id FROM uniq UNION SELECT reach.u, nb.v FROM reach JOIN nb ON reach.v = nb.u),
    comp AS (SELECT u AS seq_id, min(v) AS cluster FROM reach GROUP BY 1)"""


@query(
    "threshold_clusters",
    with_tables("uniq", recursive=True) + f", {_pairs_cte(0.2)}, {_COMPONENTS} SELECT seq_id, cluster FROM comp",
)
def threshold_clusters(spark: SparkSession, d: str) -> DataFrame:
    unique = checkpointed(unique_lines(spark, d))
    return seqs.connected_components(unique, seqs.threshold_pairs(unique, 0.2))


@query(
    "cluster_mcc",
    with_tables("uniq", recursive=True)
    + f""", {_pairs_cte(0.2)}, tight AS (SELECT * FROM pairs WHERE diffs <= floor(len * 0.1 + 1e-9)),
         {_COMPONENTS.replace('FROM pairs', 'FROM tight')},
         c AS (SELECT count(*) FILTER (x.cluster = y.cluster) AS tp, count(*) FILTER (x.cluster <> y.cluster) AS fn
               FROM pairs JOIN comp x ON x.seq_id = a JOIN comp y ON y.seq_id = b),
         s AS (SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS same, CAST(sum(k) AS BIGINT) AS n
               FROM (SELECT cluster, count(*) AS k FROM comp GROUP BY 1)),
         f AS (SELECT tp, fn, same - tp AS fp, n * (n - 1) // 2 - same - fn AS tn FROM c, s)
         SELECT tp, fn, fp, tn, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
           / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM f""",
)
def cluster_mcc(spark: SparkSession, d: str) -> DataFrame:
    unique = checkpointed(unique_lines(spark, d))
    pairs = seqs.threshold_pairs(unique, 0.2)
    # the list at the wider cutoff holds the narrower one
    tight = pairs.where(F.col("dist") <= 0.1)
    return seqs.cluster_mcc(pairs, seqs.connected_components(unique, tight)).withColumn("mcc", F.round("mcc", 6))


@query(
    "cluster_medoid",
    with_tables("uniq", recursive=True)
    + f""", {_pairs_cte(0.2)}, {_COMPONENTS},
         d2 AS (SELECT a AS seq_id, b AS other, diffs / len AS dist FROM pairs UNION ALL SELECT b, a, diffs / len FROM pairs),
         fr AS (SELECT d2.seq_id, max(dist) AS far, count(*) AS listed FROM d2 GROUP BY 1),
         sz AS (SELECT cluster, count(*) AS size FROM comp GROUP BY 1),
         sc AS (SELECT comp.cluster, comp.seq_id, size, u.n,
                  CASE WHEN coalesce(listed, 0) < size - 1 THEN 1.0 ELSE coalesce(far, 0.0) END AS far
                FROM comp JOIN sz USING (cluster) LEFT JOIN fr USING (seq_id) JOIN uniq u ON u.seq_id = comp.seq_id)
         SELECT cluster, size, seq_id AS medoid, round(far, 6) AS far FROM (SELECT *, row_number() OVER
           (PARTITION BY cluster ORDER BY far, n DESC, seq_id) AS rn FROM sc) WHERE rn = 1""",
)
def cluster_medoid(spark: SparkSession, d: str) -> DataFrame:
    unique = checkpointed(unique_lines(spark, d))
    pairs = seqs.threshold_pairs(unique, 0.2)
    clusters = seqs.connected_components(unique, pairs)
    return seqs.cluster_medoid(pairs, clusters, unique.select("seq_id", "n")).withColumn("far", F.round("far", 6))


# the scan itself, one sequence after the other within a length
_PRECLUSTER = """pr AS (SELECT * FROM (
        SELECT length(a.seq) AS len, a.seq_id AS x, b.seq_id AS e, a.n AS nx, b.n AS ne,
          list_sum(list_transform(range(1, length(a.seq) + 1),
            lambda i: CASE WHEN substr(a.seq, i, 1) <> substr(b.seq, i, 1) THEN 1 ELSE 0 END)) AS diffs
        FROM uniq a JOIN uniq b ON length(a.seq) = length(b.seq)
          AND (a.n < b.n OR (a.n = b.n AND a.seq_id > b.seq_id))) WHERE diffs <= 2),
    nb AS (SELECT len, x, list(e ORDER BY ne DESC, e) AS es,
             row_number() OVER (PARTITION BY len ORDER BY any_value(nx) DESC, x) AS i FROM pr GROUP BY len, x),
    walk(len, i, merged, x, rep) AS (
        SELECT DISTINCT len, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM nb
        UNION ALL SELECT len, i, CASE WHEN rep IS NULL THEN merged ELSE list_append(merged, x) END, x, rep FROM (
          SELECT nb.len, nb.i, walk.merged, nb.x,
            list_filter(nb.es, lambda e: NOT list_contains(walk.merged, e))[1] AS rep
          FROM walk JOIN nb ON nb.len = walk.len AND nb.i = walk.i + 1)),
    fin AS (SELECT seq_id, n, coalesce(rep, seq_id) AS rep FROM uniq LEFT JOIN walk ON walk.x = seq_id)
    SELECT seq_id, rep, CAST(sum(n) OVER (PARTITION BY rep) AS BIGINT) AS size FROM fin"""


@query("precluster", with_tables("uniq", recursive=True) + ", " + _PRECLUSTER)
def precluster(spark: SparkSession, d: str) -> DataFrame:
    return seqs.precluster(checkpointed(unique_lines(spark, d)), diffs=2)


_BIMERA = """ls AS (SELECT sample, length(seq) AS len, seq, count(*) AS n, md5(seq) AS seq_id FROM lines GROUP BY 1, 2, 3),
    pp AS (SELECT q.sample, q.seq_id, q.len, p.seq_id AS parent,
             list_max(list_filter(range(0, least(q.len, p.len) + 1), lambda k: left(q.seq, k) = left(p.seq, k))) AS pre,
             list_max(list_filter(range(0, least(q.len, p.len) + 1), lambda k: right(q.seq, k) = right(p.seq, k))) AS suf
           FROM ls q JOIN ls p ON p.sample = q.sample AND p.n >= 2 * q.n),
    m AS (SELECT sample, seq_id, max(pre) AS pre, max(suf) AS suf FROM pp GROUP BY 1, 2),
    two AS (SELECT DISTINCT a.sample, a.seq_id FROM pp a JOIN pp b ON a.sample = b.sample AND a.seq_id = b.seq_id
              AND a.parent <> b.parent AND a.pre > 0 AND b.suf > 0 AND a.pre + b.suf >= a.len)
    SELECT sample, ls.seq_id, CAST(coalesce(pre, 0) AS INT) AS prefix, CAST(coalesce(suf, 0) AS INT) AS suffix,
      two.seq_id IS NOT NULL AND greatest(pre, suf) < len AS chimera
    FROM ls LEFT JOIN m USING (sample, seq_id) LEFT JOIN two USING (sample, seq_id)"""


@query("bimera_flag", with_tables("lines") + ", " + _BIMERA)
def bimera_flag(spark: SparkSession, d: str) -> DataFrame:
    per = checkpointed(
        lines(spark, d).groupBy("sample", "seq").agg(F.count("*").alias("n")).withColumn("seq_id", F.md5("seq"))
    )
    return seqs.flag_chimeras(per)


@query(
    "consensus_taxonomy",
    with_tables("counts")
    + """, r AS (SELECT feature, sum(reads) AS n FROM counts GROUP BY 1),
         m AS (SELECT feature // 3 AS otu, n, p_type AS r1, p_brand AS r2, p_name AS r3
               FROM r JOIN part ON p_partkey = feature),
         t AS (SELECT otu, sum(n) AS size FROM m GROUP BY 1),
         v1 AS (SELECT otu, r1, sum(n) AS v FROM m GROUP BY 1, 2), v2 AS (SELECT otu, r1, r2, sum(n) AS v FROM m GROUP BY 1, 2, 3),
         v3 AS (SELECT otu, r1, r2, r3, sum(n) AS v FROM m GROUP BY 1, 2, 3, 4),
         j AS (SELECT t.otu, size, v1.r1 AS a, v1.v AS va, v2.r2 AS b, v2.v AS vb, v3.r3 AS c, v3.v AS vc FROM t
               LEFT JOIN v1 ON v1.otu = t.otu AND 100 * v1.v >= 51 * size
               LEFT JOIN v2 ON v2.otu = t.otu AND 100 * v2.v >= 51 * size
               LEFT JOIN v3 ON v3.otu = t.otu AND 100 * v3.v >= 51 * size),
         p AS (SELECT *, '(' || CAST(round(100 * va / size) AS INT) || ');' AS ca,
                 '(' || CAST(round(100 * vb / size) AS INT) || ');' AS cb,
                 '(' || CAST(round(100 * vc / size) AS INT) || ');' AS cc FROM j)
         SELECT otu, CAST(size AS BIGINT) AS size, CASE
           WHEN a IS NULL THEN repeat('unclassified(100);', 3)
           WHEN b IS NULL THEN a || ca || repeat(a || '_unclassified' || ca, 2)
           WHEN c IS NULL THEN a || ca || b || cb || b || '_unclassified' || cb
           ELSE a || ca || b || cb || c || cc END AS taxonomy FROM p""",
)
def consensus_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    n = counts(spark, d).groupBy("feature").agg(F.sum("reads").alias("n"))
    ranks = F.transform(S.parse_taxonomy(F.col("taxonomy")), lambda r: r["name"])
    members = taxonomy(spark, d).join(n, "feature").select(
        F.expr("feature div 3").alias("otu"), "n", ranks.alias("ranks")
    )
    return seqs.consensus_taxonomy(members, cutoff=51)
