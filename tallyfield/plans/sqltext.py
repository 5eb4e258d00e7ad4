"""SQL text for tail probabilities and ranks on the checking side (numeric integration, series)."""

from __future__ import annotations


def simpson(f, upper: str, n: int = 1000) -> str:
    """Integral of ``f('x')`` from 0 to ``upper`` with ``n`` Simpson steps."""
    x = f"({upper}) * i / {n}.0"
    return (
        f"(({upper}) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: "
        f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f(x)})))"
    )


def normal_two_sided(z: str) -> str:
    body = simpson(lambda x: f"exp(-0.5 * ({x}) * ({x}))", f"least(abs({z}), 12)")
    return f"greatest(0.0, 1 - 2 * {body} / sqrt(2 * pi()))"


def t_two_sided(t: str, v: str) -> str:
    """By the angle substitution t = sqrt(v) tan(angle)."""
    body = simpson(lambda x: f"pow(cos({x}), {v} - 1)", f"atan(abs({t}) / sqrt({v}))")
    const = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi())"
    return f"greatest(0.0, 1 - 2 * {const} * {body})"


def f_sf(x: str, d1: str, d2: str) -> str:
    """By the angle substitution sin^2 of the incomplete beta function."""
    a, b = f"({d2} / 2.0)", f"({d1} / 2.0)"
    body = simpson(
        lambda v: f"pow(sin({v}), {d2} - 1) * pow(cos({v}), {d1} - 1)", f"asin(sqrt({d2} / ({d2} + {d1} * greatest({x}, 0.0))))"
    )
    return f"least(1.0, 2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {body})"


def inverse(name: str, source: str, rows: list[int], key: str = "") -> str:
    """CTEs up to ``name(i, j, v)``: the inverse of the given rows and columns of ``source(i, j, v)`` by elimination.

    With ``key`` a matrix per value of that column. A row of zeros, as of a level that is not there, stays one.
    """
    k, steps = len(rows), []
    number = " ".join(f"WHEN {r} THEN {n}" for n, r in enumerate(rows))
    inside = f"i IN ({', '.join(map(str, rows))}) AND j IN ({', '.join(map(str, rows))})"
    own, keys = (f"{key}, ", f"(SELECT DISTINCT {key} FROM {source}), ") if key else ("", "")
    same = (lambda t: f" AND {t}.{key} = x.{key}") if key else (lambda t: "")
    steps.append(
        f"{name}_0 AS MATERIALIZED (SELECT {own}CASE i {number} END AS i, CASE j {number} END AS j, v FROM {source} WHERE {inside} "
        f"UNION ALL SELECT {own}a.n, {k} + b.n, CASE WHEN a.n = b.n THEN 1.0 ELSE 0.0 END FROM {keys}range({k}) a(n), range({k}) b(n))"
    )
    for s in range(k):
        last = f"{name}_{s}"
        steps.append(
            f"{name}_{s + 1} AS MATERIALIZED (SELECT {f'x.{key}, ' if key else ''}x.i, x.j, "
            f"CASE WHEN p.v = 0 THEN CASE WHEN x.i = {s} THEN 0.0 ELSE x.v END "
            f"WHEN x.i = {s} THEN x.v / p.v ELSE x.v - f.v * r.v / p.v END AS v "
            f"FROM {last} x JOIN {last} r ON r.i = {s} AND r.j = x.j{same('r')} JOIN {last} f ON f.i = x.i AND f.j = {s}{same('f')} "
            f"JOIN {last} p ON p.i = {s} AND p.j = {s}{same('p')})"
        )
    back = " ".join(f"WHEN {n} THEN {r}" for n, r in enumerate(rows))
    steps.append(
        f"{name} AS MATERIALIZED (SELECT {own}CASE i {back} END AS i, CASE j - {k} {back} END AS j, v FROM {name}_{k} WHERE j >= {k})"
    )
    return ", ".join(steps)


def chi2_sf(x: str, df: str) -> str:
    a, h = f"({df} / 2.0)", f"({x} / 2.0)"
    return (
        f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 600), lambda k: "
        f"exp(-{h} + ({a} + k) * ln({h}) - lgamma({a} + k + 1))))) END"
    )


def midrank(value: str, strata: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {strata} ORDER BY {value}) "
        f"+ (count(*) OVER (PARTITION BY {strata}, {value}) - 1) / 2.0)"
    )


def probit(p: str) -> str:
    """Normal quantile from the same published rational approximation."""
    from ..functions.tails import PROBIT

    def poly(cs, x):
        text = repr(cs[-1])
        for c in reversed(cs[:-1]):
            text = f"({text} * {x} + {c!r})"
        return text

    q, r1 = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    (ca, cb), (ma, mb), (fa, fb) = PROBIT["central"], PROBIT["middle"], PROBIT["far"]
    x0, x1, x2 = f"(0.180625 - {q} * {q})", f"({r1} - 1.6)", f"({r1} - 5.0)"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * CAST({poly(ca, x0)} AS DOUBLE) / {poly(cb, x0)} "
        f"WHEN {r1} <= 5.0 THEN sign({q}) * {poly(ma, x1)} / {poly(mb, x1)} "
        f"ELSE sign({q}) * {poly(fa, x2)} / {poly(fb, x2)} END"
    )


def bh(p: str, strata: str, tiebreak: str) -> str:
    """Benjamini-Hochberg as two nested windows; needs ``rn`` = row number by ascending p."""
    return (
        f"least(1.0, min({p} * m / rn) OVER (PARTITION BY {strata} ORDER BY {p} DESC, {tiebreak} DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    )
