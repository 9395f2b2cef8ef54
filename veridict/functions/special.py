"""Special functions as columns, for tests and intervals.

Sums and continued fractions are folds over a sequence whose length follows
from the arguments, so they run per row on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _fold(steps: Column, start: dict[str, Column], step) -> Column:
    """A struct of doubles, carried through step(fields, k) for k = 1 to ``steps``."""
    state = F.struct(*(v.cast("double").alias(k) for k, v in start.items()))

    def one(s: Column, k: Column) -> Column:
        return F.struct(*(v.cast("double").alias(n) for n, v in step({n: s[n] for n in start}, k.cast("double")).items()))

    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), state, one)


def _let(values: dict[str, Column], result) -> Column:
    """``result`` of the values, each of which is evaluated once however often it is used."""
    return F.transform(F.array(F.struct(*(v.cast("double").alias(k) for k, v in values.items()))), lambda s: result(*(s[k] for k in values)))[0]


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0 (Stirling's series after a shift by 8; error below 1e-13)."""
    shifted, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    series = sum((F.lit(c) / F.pow(shifted, F.lit(float(p))) for c, p in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9))), F.lit(0.0))
    return (shifted - 0.5) * F.ln(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0: by its series below x = a + 1, else by its continued fraction."""
    return _let({"a": a, "x": x}, _gamma_tail)


def _gamma_tail(a: Column, x: Column) -> Column:
    steps = 100 + 12 * F.ceil(F.sqrt(a))
    front = F.exp(-x + a * F.ln(x) - log_gamma(a))
    sums = _fold(steps, {"t": 1 / a, "s": 1 / a}, lambda s, k: {"t": s["t"] * x / (a + k), "s": s["s"] + s["t"] * x / (a + k)})

    def fraction(s: dict, k: Column) -> dict:
        an, b = -k * (k - a), x + 1 - a + 2 * k
        d = 1 / (an * s["d"] + b)
        c = b + an / s["c"]
        return {"c": c, "d": d, "h": s["h"] * d * c}

    start = {"c": F.lit(1 / _TINY), "d": 1 / (x + 1 - a), "h": 1 / (x + 1 - a)}
    value = F.when(x < a + 1, 1 - front * sums["s"]).otherwise(front * _fold(steps, start, fraction)["h"])
    return F.when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def chi_square_p(x: Column, dof: Column) -> Column:
    """P(X >= x) of the chi-square distribution; null where x is null or there are no degrees of freedom."""
    return F.when((dof > 0) & x.isNotNull(), gamma_tail(dof / 2.0, x / 2.0))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    steps = 60 + 4 * F.ceil(F.sqrt(F.greatest(a, b)))

    def step(s: dict, m: Column) -> dict:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # one factor of Lentz's product for the even term, one for the odd
        d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        return {"c": c2, "d": d2, "h": s["h"] * d1 * c1 * d2 * c2}

    first = 1 / (1 - (a + b) * x / (a + 1))
    return _fold(steps, {"c": F.lit(1.0), "d": first, "h": first}, step)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), a and b above 0."""
    return _let({"a": a, "b": b, "x": x}, _incomplete_beta)


def _incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    small = lambda p, q, y: _beta_fraction(p, q, y) / p
    value = F.when(x > (a + 1) / (a + b + 2), 1 - front * _let({"p": b, "q": a, "y": 1 - x}, small)).otherwise(front * small(a, b, x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of the binomial distribution."""
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(incomplete_beta(n - k, k + 1, 1 - p))


def binomial_quantile(q: float | Column, n: Column, p: Column, steps: int = 40) -> Column:
    """The least k with P(X <= k) >= q, by bisection; ``steps`` halvings hold for n below 2^steps."""
    state = F.struct(F.lit(-1).cast("long").alias("low"), n.cast("long").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2)
        known = F.struct(s["low"].alias("low"), s["high"].alias("high"), middle.alias("middle"))
        # the distribution is evaluated once for each middle
        tried = F.transform(F.array(known), lambda t: F.struct(t["low"].alias("low"), t["high"].alias("high"), t["middle"].alias("middle"), (binomial_cdf(t["middle"], n, p) >= q).alias("enough")))
        moved = F.transform(tried, lambda t: F.struct(F.when(t["enough"], t["low"]).otherwise(t["middle"]).alias("low"), F.when(t["enough"], t["middle"]).otherwise(t["high"]).alias("high")))
        return F.when(s["high"] - s["low"] > 1, moved[0]).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve)["high"]


def sql_chi_square_p(x: str, dof: str, terms: int = 2000) -> str:
    """DuckDB counterpart of ``chi_square_p`` by another way: the series of the lower function, term by term."""
    half, a = f"({x}) / 2.0", f"({dof}) / 2.0"
    return f"""CASE WHEN {dof} > 0 AND {x} IS NOT NULL THEN CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range({terms}),
        lambda k: exp(-{half} + ({a} + k) * ln({half}) - lgamma({a} + k + 1))))) END END"""
