"""Quantiles and tails of distributions as column expressions: built-in functions alone, for reduced rows or whole columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), constant term first; the denominators begin with 1.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
OUTER = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Terms of the series of the normal distribution; up to NEAR they are enough for sixteen digits.
TERMS, NEAR = 200, 8.0
#: Up to this many differences without ties the signed-rank tail is exact.
EXACT = 50


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1 to sixteen digits; null elsewhere."""
    q = p - 0.5
    ratio = lambda pair, x: _polynomial(pair[0], x) / _polynomial(pair[1], x)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, ratio(MIDDLE, r - 1.6)).otherwise(ratio(OUTER, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(CENTRAL, 0.180625 - q * q)).otherwise(tail))


def _series(first: Column, n: Column, factor: Callable[[Column], Column]) -> Column:
    """first + first * factor(1) + first * factor(1) * factor(2) ...: n more terms after the first."""
    start = F.struct(first.alias("term"), first.alias("sum"))
    steps = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    def more(x: Column, k: Column) -> Column:
        term = x["term"] * factor(k.cast("double"))
        return F.struct(term.alias("term"), (x["sum"] + term).alias("sum"))

    return F.aggregate(steps, start, more, lambda x: x["sum"])


def normal_tail(z: Column) -> Column:
    """P(Z > z): a series near 0, an asymptotic one beyond."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / sqrt(2 * pi)
    near = 0.5 - density * _series(x, F.lit(TERMS), lambda k: x * x / (2 * k + 1))
    far = density / x * (1 - 1 / (x * x) + 3 / F.pow(x, 4) - 15 / F.pow(x, 6) + 105 / F.pow(x, 8))
    upper = F.when(x <= NEAR, near).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution with a whole number of degrees of freedom; null without a t or with none of them."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c = F.cos(angle) * F.cos(angle)
    even = F.sin(angle) * _series(F.lit(1.0), df / 2 - 1, lambda k: c * (2 * k - 1) / (2 * k))
    odd = angle + F.when(df >= 3, F.sin(angle) * F.cos(angle) * _series(F.lit(1.0), (df - 3) / 2, lambda k: c * 2 * k / (2 * k + 1))).otherwise(0.0)
    inside = F.when(df % 2 == 0, even).otherwise(odd * 2 / pi)
    return F.when(t.isNotNull() & ~F.isnan(t) & (df >= 1), F.greatest(1 - inside, F.lit(0.0)))


def _signed_rank_ways(n: Column) -> Column:
    """How many of the 2^n choices of signs give each sum of positive ranks, from 0 to EXACT (EXACT + 1) / 2."""
    most = EXACT * (EXACT + 1) // 2
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), most))
    ranks = F.sequence(F.lit(1), F.least(n, F.lit(EXACT)).cast("int"))
    return F.aggregate(ranks, start, lambda ways, r: F.transform(ways, lambda x, i: x + F.when(i >= r, F.get(ways, i - r)).otherwise(0.0)))


def signed_rank_p(w_plus: Column, n: Column, ties: Column) -> Column:
    """Struct (two_sided, greater) of Wilcoxon's statistic over n differences, none of them 0; nulls without any.

    Exact up to EXACT differences without ties, else the normal approximation, its variance less by ties = sum of t^3 - t over
    groups of t equal ones.
    """
    whole = F.pow(F.lit(2.0), n.cast("double"))
    total = lambda low, high: F.aggregate(F.slice(_signed_rank_ways(n), low.cast("int") + 1, F.greatest(high - low + 1, F.lit(0)).cast("int")), F.lit(0.0), lambda a, x: a + x) / whole
    half = n * (n + 1) / 2
    upper, lower = total(F.ceil(w_plus), half), total(F.lit(0), F.floor(w_plus))
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    z = (w_plus - half / 2) / F.when(sd > 0, sd)
    exact = (n <= EXACT) & (ties == 0)
    two = F.when(exact, F.least(F.lit(1.0), 2 * F.least(upper, lower))).otherwise(F.least(F.lit(1.0), 2 * normal_tail(F.abs(z))))
    return F.struct(F.when(n >= 1, two).alias("two_sided"), F.when(n >= 1, F.when(exact, upper).otherwise(normal_tail(z))).alias("greater"))


def quantile_sql(p: str) -> str:
    """normal_quantile() as SQL."""

    def polynomial(coefficients: Sequence[float], x: str) -> str:
        out = repr(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = f"({out} * {x} + {c!r})"
        return out

    ratio = lambda pair, x: f"{polynomial(pair[0], x)} / {polynomial(pair[1], x)}"
    q, r = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(CENTRAL, f'(0.180625 - {q} * {q})')} WHEN {r} <= 5 THEN sign({q}) * {ratio(MIDDLE, f'({r} - 1.6)')} ELSE sign({q}) * {ratio(OUTER, f'({r} - 5)')} END"


def tail_sql(z: str) -> str:
    """normal_tail() as SQL, for |z| up to NEAR: the series by double factorials."""
    x = f"abs({z})"
    series = f"list_sum(list_transform(range(0, {TERMS}), lambda j_: CASE WHEN {x} > 0 THEN exp((2 * j_ + 1) * ln({x}) - (lgamma(2 * j_ + 2) - j_ * ln(2) - lgamma(j_ + 1))) ELSE 0 END))"
    upper = f"(0.5 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series})"
    return f"CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END"


def t_sql(t: str, df: str) -> str:
    """t_two_sided() as SQL: the finite sums by their binomial coefficients."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda j_: exp(lgamma(2 * j_ + 1) - 2 * lgamma(j_ + 1) - 2 * j_ * ln(2)) * cos({angle}) ** (2 * j_)))"
    odd = f"({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda j_: exp(2 * j_ * ln(2) + 2 * lgamma(j_ + 1) - lgamma(2 * j_ + 2)) * cos({angle}) ** (2 * j_))), 0)) * 2 / pi()"
    return f"CASE WHEN {df} >= 1 THEN greatest(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END, 0) END"


#: Recursive table ways(r, x): for r differences, in how many ways each sum of positive ranks comes about.
WAYS_SQL = f"""ways AS (SELECT 0 AS r, list_prepend(1::DOUBLE, list_transform(range(0, {EXACT * (EXACT + 1) // 2}), lambda i: 0::DOUBLE)) AS x
  UNION ALL SELECT r + 1, list_transform(range(0, {EXACT * (EXACT + 1) // 2 + 1}), lambda i: x[i + 1] + CASE WHEN i > r THEN x[i - r] ELSE 0 END) FROM ways WHERE r < {EXACT})"""


def signed_rank_sql(w: str, n: str, ties: str, alternative: str) -> str:
    """signed_rank_p() as SQL beside a row of ways with r = least(n, EXACT)."""
    z = f"(({w} - {n} * ({n} + 1) / 4.0) / sqrt(({n} * ({n} + 1) * (2 * {n} + 1) - {ties} / 2.0) / 24.0))"
    upper, lower = f"list_sum(ways.x[ceil({w})::BIGINT + 1:]) / 2.0 ** {n}", f"list_sum(ways.x[:floor({w})::BIGINT + 1]) / 2.0 ** {n}"
    if alternative == "greater":
        return f"CASE WHEN {n} <= {EXACT} AND {ties} = 0 THEN {upper} ELSE {tail_sql(z)} END"
    return f"least(1, 2 * CASE WHEN {n} <= {EXACT} AND {ties} = 0 THEN least({upper}, {lower}) ELSE {tail_sql(f'abs({z})')} END)"
