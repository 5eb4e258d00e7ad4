"""Column functions with the conventions of the analysis tables: NULL-aware text, first-match
replacement, significant digits, sample-code parsing and sequence measures. All stay on the JVM
side."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED_STOP_AGE = 28  # the supplemented feed is given before this age (days)
CHALLENGE_AGE = 20  # day of challenge


def paste(*cols: Column | str, sep: str = "") -> Column:
    """Concatenate; a NULL piece contributes the text ``NA``."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def str_sub(x: Column, start: int, end: int = -1) -> Column:
    """Characters ``start``..``end``, 1-based and inclusive; negatives count from the end."""
    n = F.length(x)
    lo = F.lit(start) if start > 0 else n + start + 1
    hi = F.lit(end) if end > 0 else n + end + 1
    lo = F.greatest(lo, F.lit(1))
    return F.substring(x, lo, F.greatest(hi - lo + 1, F.lit(0)))


def str_extract(x: Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL."""
    return F.when(F.regexp_like(x, F.lit(pattern)), F.regexp_extract(x, pattern, group))


def str_replace_first(x: Column, pattern: str, replacement: str = "") -> Column:
    """Replace only the first match; ``pattern`` must not use numbered groups."""
    return F.regexp_replace(x, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def as_numeric(x: Column) -> Column:
    """Text that is not a number becomes NULL."""
    return x.try_cast("double")


def as_integer(x: Column) -> Column:
    return x.try_cast("double").try_cast("int")


def log_or_limit(x: Column, base10: bool = False) -> Column:
    """Logarithm with log(0) = -Infinity and NaN for negatives, where Spark's builtin gives NULL."""
    f = F.log10(x) if base10 else F.log(x)
    return F.when(x > 0, f).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def _stirling_rest(x: Column) -> Column:
    """What ``ln x!`` has beyond ``(x + 1/2) ln x - x + ln(2 pi) / 2``, for ``x`` of 16 and more."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_factorial(x: Column) -> Column:
    """``ln x!`` of a whole number of 0 or more."""
    few = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    d = F.greatest(x, F.lit(16)).cast("double")
    many = (d + 0.5) * F.log(d) - d + 0.5 * math.log(2 * math.pi) + _stirling_rest(d)
    return F.when(x < 16, F.get(few, x.cast("int"))).otherwise(many)


def log_falling(a: Column, n: Column) -> Column:
    """``ln(a (a-1) .. (a-n+1))`` for ``0 <= n <= a``, without the difference of two large logarithms."""
    x, k = a.cast("double"), n.cast("double")
    left = F.greatest(x - k, F.lit(16.0))
    near = (left + 0.5) * -F.log1p(-k / F.greatest(x, F.lit(1.0))) + k * F.log(F.greatest(x, F.lit(1.0))) - k
    near = near + _stirling_rest(F.greatest(x, F.lit(16.0))) - _stirling_rest(left)
    return F.when(a - n < 16, log_factorial(a) - log_factorial(F.greatest(a - n, F.lit(0)))).otherwise(near)


def signif(x: Column, digits: int = 3) -> Column:
    """Round to significant digits."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    # multiply or divide so that the power used is a whole number, which a double holds exactly
    inv = F.pow(F.lit(10.0), (digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).when(p >= 1, F.bround(x / p) * p).otherwise(F.bround(x * inv) / inv)


def number_text(x: Column) -> Column:
    """A number as a reader writes it: no trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def stage_label(age: Column) -> Column:
    """``22 (2)``: age and days after challenge. Integer age in, text out, so apply it last."""
    return F.concat(age.cast("string"), F.lit(" ("), (age - CHALLENGE_AGE).cast("string"), F.lit(")"))


def feed_label(diet: Column, age: Column, control: str = "ctl", supplement: str = "+GOS") -> Column:
    """Feed given at sampling: the supplement only before the feed change, from integer age."""
    return F.when(diet == control, F.lit(control)).when(age < FEED_STOP_AGE, F.lit(supplement)).otherwise(control)


def cohort_label(diet: Column, challenge: Column) -> Column:
    names = {"ctl unc": "ctl x Mock", "gos unc": "jGOS x Mock", "ctl sal": "ctl x SE", "gos sal": "jGOS x SE"}
    key = F.concat_ws(" ", diet, challenge)
    return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), names.items(), F.when(F.lit(False), F.lit("")))


def challenge_label(code: Column) -> Column:
    return F.when(code == "sal", "SE").when(code == "unc", "mock").otherwise("fail")


def stars(p: Column, otherwise: str | None = None) -> Column:
    out = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
    return out.when(p.isNotNull(), F.lit(otherwise)) if otherwise else out


def effect_class(p1: Column, p2: Column, effect: Column) -> Column:
    """Conservative call of two methods: either p over 0.05 wins, else the sign of the effect."""
    return (
        F.when((p1 > 0.05) | (p2 > 0.05), "p.adj > 0.05")
        .when(effect < 0, "Negative LFC")
        .when(effect > 0, "Positive LFC")
    )


def greatest_strict(*cols: Column) -> Column:
    """Row maximum that is NULL when any input is NULL."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~missing, F.greatest(*cols))


def row_sum(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """Sum over the numeric columns of a row, NULL as zero."""
    from pyspark.sql.types import NumericType

    names = cols or [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in names])


def numeric_id(x: Column) -> Column:
    """Number inside an id such as ``Otu0007`` without its leading zeros."""
    return str_extract(x, r"\d+").try_cast("int")


def parse_taxonomy(x: Column) -> Column:
    """``name(conf);name(conf);`` -> array<struct<rank, name, conf>>; the empty last piece is dropped."""
    pieces = F.filter(F.split(x, ";"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            F.regexp_extract(p, r"^([^(]+)", 1).alias("name"),
            F.regexp_extract(p, r"\((\d+)\)", 1).try_cast("int").alias("conf"),
        ),
    )


def separate(x: Column, names: Sequence[str], sep: str) -> dict[str, Column]:
    """Split into named columns: missing pieces NULL, extra pieces dropped."""
    parts = F.split(x, sep)
    return {n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(names)}


def syntactic_name(name: str) -> str:
    """Column-name repair: every character outside letters, digits, dot, underscore becomes a dot."""
    fixed = re.sub(r"[^A-Za-z0-9._]", ".", name)
    return fixed if re.match(r"[A-Za-z]|\.(?![0-9])", fixed) else "X" + fixed


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def ambiguous(seq: Column, alphabet: str = "ACGT") -> Column:
    """Characters outside the alphabet (a regex character class body)."""
    return F.regexp_count(seq, F.lit(f"(?s)[^{alphabet}]"))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one repeated character."""
    runs = F.regexp_extract_all(seq, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def first_base(seq: Column, gaps: str = r"\.\-") -> Column:
    """1-based position of the first character that is not a gap; 0 when there is none."""
    return F.coalesce(F.length(F.regexp_extract(seq, f"(?s)^([{gaps}]*)[^{gaps}]", 1)) + 1, F.lit(0)) * F.when(
        F.regexp_like(seq, F.lit(f"(?s)[^{gaps}]")), 1
    ).otherwise(0)


def last_base(seq: Column, gaps: str = r"\.\-") -> Column:
    """1-based position of the last character that is not a gap."""
    return F.length(F.regexp_replace(seq, f"(?s)[{gaps}]+\\z", ""))
