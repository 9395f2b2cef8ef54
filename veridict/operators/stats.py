"""Closed-form statistics over counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions.special import chi_square_p

#: Fixed value: the 97.5 % point of the standard normal distribution.
Z = 1.959963984540054


def wilson(correct: str, total: str, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval, within 0 and 1; null without trials."""
    n, p = F.col(total).cast("double"), F.try_divide(F.col(correct).cast("double"), F.col(total))
    scale = F.try_divide(F.lit(1.0), 1 + z * z / n)
    middle = (p + z * z / (2 * n)) * scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * scale
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def proportions(rows: DataFrame, y: str, *keys: str) -> DataFrame:
    """n, accuracy and Wilson ends of a 0/1 column for each key."""
    counts = rows.groupBy(*keys).agg(F.sum(y).alias("c"), F.count(y).alias("n")).where("n > 0")
    low, high = wilson("c", "n")
    return counts.select(
        *keys, "n", F.round(F.col("c") / F.col("n"), 6).alias("acc"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high")
    )


def chi_square(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Statistic, degrees of freedom, p-value, Cramer's V and least expected count of a table of counts.

    Cells that are not listed count as 0.  Only listed cells meet their
    margins: with expected counts e = r k / n the statistic is
    n (sum of o^2 / (r k) - 1), to which other cells add nothing.  The
    continuity correction applies at one degree of freedom, where all four
    cells are equally far from their expected counts.
    """
    kept = counts.where(F.col(n) > 0).select(F.col(row).alias("row"), F.col(column).alias("column"), F.col(n).alias("n"))
    cells = kept.groupBy("row", "column").agg(F.sum("n").cast("double").alias("o"))
    rows, columns = cells.groupBy("row").agg(F.sum("o").alias("r")), cells.groupBy("column").agg(F.sum("o").alias("k"))
    share = F.col("o") * F.col("o") / (F.col("r") * F.col("k"))
    inner = cells.join(rows, "row").join(columns, "column").agg(F.sum(share).alias("share"), F.max_by(F.struct("o", "r", "k"), "o").alias("cell"))
    side = lambda df, c, name: df.agg(F.count("*").alias(name), F.min(c).alias(f"least_{name}"), F.sum(1 / F.col(c)).alias(f"inverse_{name}"), F.sum(c).alias(f"total_{name}"))
    one = inner.join(F.broadcast(side(rows, "r", "a"))).join(F.broadcast(side(columns, "k", "b")))  # a row each
    total, dof = F.col("total_a"), (F.col("a") - 1) * (F.col("b") - 1)
    gap = F.abs(F.col("cell.o") - F.col("cell.r") * F.col("cell.k") / total)
    gap = gap - F.least(F.lit(0.5), gap)
    corrected = gap * gap * total * F.col("inverse_a") * F.col("inverse_b")
    out = one.select("a", "b", total.alias("total"), dof.alias("dof"), (F.col("least_a") * F.col("least_b") / total).alias("least"),
                     F.greatest(F.lit(0.0), F.when(dof == 1, corrected).otherwise(total * (F.col("share") - 1))).alias("chi2"))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("total") * (F.least("a", "b") - 1)))
    return out.select(
        F.round("chi2", 6).alias("chi2"), F.col("dof").cast("long").alias("dof"), F.round(chi_square_p(F.col("chi2"), F.col("dof")), 6).alias("p"),
        F.round(v, 6).alias("cramers_v"), F.round("least", 6).alias("min_expected"),
    )


def anova(items: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F and eta squared of ``value`` between groups; null where they are not defined."""
    per = items.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    s = per.agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("m")).alias("sum"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sm"),
    )
    grand = F.col("sum") * F.col("sum") / F.col("total")
    between, within = F.col("sm") - grand, F.col("ss") - F.col("sm")
    f = F.try_divide(between / F.nullif(F.col("k") - 1, F.lit(0)), within / F.nullif(F.col("total") - F.col("k"), F.lit(0)))
    return s.select(
        F.round(f, 6).alias("f"), F.round(F.try_divide(between, between + within), 6).alias("eta2"),
        "k", F.col("total").alias("n"),
    )


def deviance(counts: DataFrame, valid: str = "n_valid", total: str = "n_total") -> DataFrame:
    """G squared, degrees of freedom and p-value of validity by group: the deviance drop of a one-factor binomial model."""
    x, n = F.col(valid).cast("double"), F.col(total).cast("double")
    term = lambda a, e: F.when(a > 0, a * F.ln(a / e)).otherwise(0.0)
    overall = counts.agg((F.sum(valid) / F.sum(total)).alias("p"))
    rows = counts.join(F.broadcast(overall))
    g = 2 * F.sum(term(x, n * F.col("p")) + term(n - x, n * (1 - F.col("p"))))
    out = rows.agg(g.alias("g2"), (F.count("*") - 1).alias("dof"))
    return out.select(F.round("g2", 6).alias("g2"), "dof", F.round(chi_square_p(F.col("g2"), F.col("dof")), 6).alias("p"))


def pairwise_proportions(counts: DataFrame, key: str, valid: str = "n_valid", total: str = "n_total") -> DataFrame:
    """Every two groups' continuity-corrected chi-square statistic, p-value, and p adjusted by false discovery rate.

    ``counts`` has one row for each group; groups are few.  The p-value of one
    degree of freedom comes from the normal tail (Abramowitz and Stegun
    7.1.26, absolute error below 2e-7).
    """
    side = lambda s: counts.select(F.col(key).alias(s), F.col(valid).alias(f"x{s}"), F.col(total).alias(f"n{s}"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b"))
    n = (F.col("na") + F.col("nb")).cast("double")
    p = (F.col("xa") + F.col("xb")) / n
    gap = F.abs(F.col("xa") / F.col("na") - F.col("xb") / F.col("nb"))
    shrink = F.least(F.lit(0.5), gap / (1 / F.col("na") + 1 / F.col("nb")))
    chi2 = F.try_divide(
        F.pow(gap - shrink * (1 / F.col("na") + 1 / F.col("nb")), F.lit(2)), p * (1 - p) * (1 / F.col("na") + 1 / F.col("nb"))
    )
    tested = pairs.select("a", "b", chi2.alias("chi2")).withColumn("p", erfc(F.sqrt(F.col("chi2") / 2)))
    m, rank = F.count("p").over(Window.partitionBy(F.lit(0))), F.rank().over(Window.partitionBy(F.lit(0)).orderBy("p"))
    raw = tested.withColumn("_q", F.col("p") * m / rank)
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.select(
        "a", "b", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p"),
        F.round(F.least(F.lit(1.0), F.min("_q").over(later)), 6).alias("p_adjusted"),
    )


def erfc(x: Column) -> Column:
    """Complementary error function of a value that is not negative (rational approximation)."""
    t = 1 / (1 + 0.3275911 * x)
    #: Coefficients of the approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return poly * F.exp(-x * x)


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x) of the chi-square distribution, for results of one row."""
    if x <= 0:
        return 1.0
    a, half = dof / 2, x / 2
    if half < a + 1:  # series of the lower incomplete gamma function
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= half / k
            total += term
        return 1 - total * math.exp(-half + a * math.log(half) - math.lgamma(a))
    b, c = half + 1 - a, 1e300  # continued fraction of the upper one (Lentz)
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-half + a * math.log(half) - math.lgamma(a))


def quiz_interval(runs: DataFrame, *keys: str) -> DataFrame:
    """Mean over quizzes with a 95 % t interval within 0 and 1; no interval for one quiz."""
    out = runs.groupBy(*keys).agg(F.avg("acc").alias("m"), F.stddev_samp("acc").alias("s"), F.count("acc").alias("n"))
    half = t_quantile(F.col("n") - 1) * F.col("s") / F.sqrt("n")
    return out.select(
        *keys, "n", F.round("m", 6).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("m") - half), 6).alias("low"),
        F.round(F.least(F.lit(1.0), F.col("m") + half), 6).alias("high"),
    )


def t_tail(x: float, dof: int) -> float:
    """Probability that Student's t is above x > 0, by its finite series."""
    theta = math.atan(x / math.sqrt(dof))
    cosine, total, term = math.cos(theta), 0.0, 1.0
    if dof % 2:
        for k in range(1, dof, 2):
            term = math.cos(theta) if k == 1 else term * cosine**2 * (k - 1) / k
            total += term
        inside = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        for k in range(0, dof, 2):
            term = 1.0 if k == 0 else term * cosine**2 * (k - 1) / k
            total += term
        inside = math.sin(theta) * total
    return (1 - inside) / 2


def _t_point(dof: int, tail: float = 0.025) -> float:
    low, high = 0.0, 100.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, dof) > tail else (low, middle)
    return (low + high) / 2


#: Degrees of freedom up to which the 97.5 % point is taken from a table.
T_TABLE = tuple(_t_point(d) for d in range(1, 61))


def t_quantile(dof: Column) -> Column:
    """The 97.5 % point of Student's t: exact up to 60 degrees of freedom, above by expansion around the normal (error below 1e-8)."""
    v, z = dof.cast("double"), Z
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    g.append((79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    series = F.lit(z) + sum((F.lit(c) / F.pow(v, F.lit(k + 1)) for k, c in enumerate(g)), F.lit(0.0))
    table = F.try_element_at(F.array(*map(F.lit, T_TABLE)), F.when(dof.between(1, len(T_TABLE)), dof.cast("int")).otherwise(len(T_TABLE)))
    return F.when(dof < 1, None).when(dof <= len(T_TABLE), table).otherwise(series)
