"""Missing keys, levels and values, and files with awkward records."""

import math

import pytest

from tallyfield.operators import stats, tidy
from tallyfield.sources import tables


def trial(spark, extra=()):
    rows = [("s", "ab"[i % 2], "xy"[i // 2 % 2], float(i * i % 17)) for i in range(24)]
    return spark.createDataFrame([*rows, *extra], "s string, g string, h string, v double")


ODD = [("s", None, "x", 3.0), ("s", "a", None, 9.0), ("s", None, None, 5.0), ("s", "b", "y", math.nan), ("s", "a", "x", None)]


def test_rank_tests_use_complete_rows_only(spark):
    plain, odd = trial(spark), trial(spark, [r for r in ODD if r[1] is None or r[3] is None or math.isnan(r[3])])
    for test in (stats.kruskal_wallis, stats.dunn_test, stats.wilcoxon, stats.pairwise_wilcoxon):
        assert test(odd, ["s"], "v", "g").collect() == test(plain, ["s"], "v", "g").collect()
    assert stats.kruskal_wallis(odd, ["s"], "v", "g").first()["n"] == 24


def test_anova_uses_complete_rows_only(spark):
    def table(extra):
        rows = stats.anova_two_way(trial(spark, extra), ["s"], "v", "g", "h").collect()
        return sorted((r["term"], r["df"], round(r["sum_sq"], 9)) for r in rows)

    assert table(ODD) == table(())


def test_missing_keys_match(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    assert {(r["k"], r["x"], r["y"]) for r in tidy.natural_left_join(left, right).collect()} == {("a", 1, 10), (None, 2, 20), ("b", 3, None)}
    kept = tidy.left_join_keep(left, right, ["k"], ("_l", "_r")).collect()
    assert {(r["x_l"], r["y_r"]) for r in kept} == {(1, 10), (2, 20), (3, None)}


def test_fasta_headers_and_line_ends(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_bytes(b">s1 A>G variant\r\nACGT\r\nAC\r\n>s2\nTT\n")
    assert [tuple(r) for r in tables.read_fasta(spark, str(path)).orderBy("seq_id").collect()] == [("s1", "ACGTAC", 6), ("s2", "TT", 2)]


def test_fastq_qualities(spark, tmp_path):
    path = tmp_path / "a.fastq"
    path.write_text("@r1\nACGT\n+\n@@II\n@r2 x\nA\n+\n@\n@r3\nAC\n+\nII\n@r4\nACG\n+\n@+I\n")
    got = [tuple(r) for r in tables.read_fastq(spark, str(path)).orderBy("seq_id").collect()]
    assert got == [("r1", "ACGT", "@@II"), ("r2", "A", "@"), ("r3", "AC", "II"), ("r4", "ACG", "@+I")]


def test_a_list_has_a_bound(spark):
    from tallyfield.operators import reports

    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)] + [(0, None)], "g int, x double")
    assert reports.list_by_group(df, ["g"], "x", "xs", most=10).count() == 2
    with pytest.raises(ValueError, match="more than the 9"):
        reports.list_by_group(df, ["g"], "x", "xs", most=9)
