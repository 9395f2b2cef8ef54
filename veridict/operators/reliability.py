"""Agreement between judges.

Ratings have unit, judge and a value column; units with fewer than two values
carry no pairs.  Everything is closed-form over counts, so data-sized joins
are avoided: a unit's values are summed to a few counts first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_rating(ratings: DataFrame, order: str) -> DataFrame:
    """One row for each (unit, judge): the last by ``order``."""
    rest = [c for c in ratings.columns if c not in ("unit", "judge")]
    kept = ratings.groupBy("unit", "judge").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return kept.select("unit", "judge", "r.*")


def nominal(a: Column, b: Column) -> Column:
    return (a != b).cast("double")


def interval(a: Column, b: Column) -> Column:
    return ((a - b) * (a - b)).cast("double")


def krippendorff(ratings: DataFrame, value: str, distance: Callable[[Column, Column], Column], *groups: str) -> DataFrame:
    """alpha per group over units with two values or more.

    ``distance`` builds a column from two values.  With at most one pairable
    value alpha is null; without expected disagreement it is 1 if none is
    observed, else null.  Disagreement is summed within a unit's distinct
    values and over the group's distinct values, which are few.
    """
    keys = list(groups)
    counts = ratings.where(F.col(value).isNotNull()).groupBy(*keys, "unit", F.col(value).alias("v")).agg(F.count("*").alias("c"))
    units = counts.groupBy(*keys, "unit").agg(F.sum("c").alias("n"), F.collect_list(F.struct("v", "c")).alias("vs"))
    units = units.where("n > 1")
    own = F.aggregate(
        "vs", F.lit(0.0),
        lambda s, x: s + F.aggregate("vs", F.lit(0.0), lambda t, y: t + x["c"] * y["c"] * distance(x["v"], y["v"])),
    )
    observed = units.groupBy(*keys).agg(F.sum(own / (F.col("n") - 1)).alias("o"), F.sum("n").alias("total"))
    margins = units.select(*keys, F.explode("vs").alias("e")).groupBy(*keys, "e.v").agg(F.sum("e.c").alias("c"))
    margins = margins.groupBy(*keys).agg(F.collect_list(F.struct("v", "c")).alias("vs"))
    expected = margins.select(*keys, own.alias("e"))
    both = observed.join(expected, keys) if keys else observed.join(F.broadcast(expected))
    do, de = F.col("o") / F.col("total"), F.col("e") / (F.col("total") * (F.col("total") - 1))
    alpha = F.when(F.col("total") <= 1, None).when(de == 0, F.when(do == 0, 1.0)).otherwise(1 - F.try_divide(do, de))
    return both.select(*keys, F.round(alpha, 6).alias("alpha"), F.col("total").alias("n_pairable"))


def reliability_counts(ratings: DataFrame, value: str, n_judges: int, *groups: str) -> DataFrame:
    """Units, units with two ratings or more, complete units, and ratings per unit."""
    per = ratings.where(F.col(value).isNotNull()).groupBy(*groups, "unit").agg(F.count_distinct("judge").alias("k"))
    return per.groupBy(*groups).agg(
        F.count("*").alias("n_units"), F.count_if(F.col("k") >= 2).alias("n_units_2plus"),
        F.count_if(F.col("k") == n_judges).alias("n_complete"), F.round(F.avg("k"), 6).alias("avg_raters"),
    )


def rater_histogram(ratings: DataFrame, *groups: str) -> DataFrame:
    """How many units have how many ratings and how many of them pass."""
    passed = F.count_if(F.upper(F.trim("verdict")) == "PASS")
    per = ratings.groupBy(*groups, "unit").agg(F.count("*").alias("n_raters"), passed.alias("n_pass"))
    return per.groupBy(*groups, "n_raters", "n_pass").agg(F.count("*").alias("n_units"))


def leave_one_out_verdicts(ratings: DataFrame, min_others: int = 2) -> DataFrame:
    """judge, unit, own, consensus: each verdict beside the strict majority of the others.

    Consensus is null where the others tie; rows with fewer than
    ``min_others`` others are left out.
    """
    per = Window.partitionBy("unit")
    p = F.when(F.upper(F.trim("verdict")) == "PASS", 1).when(F.upper(F.trim("verdict")) == "FAIL", 0)
    own = ratings.select("unit", "judge", p.alias("own")).where("own is not null")
    counted = own.withColumn("n", F.count("*").over(per) - 1).withColumn("p", F.sum("own").over(per) - F.col("own"))
    consensus = F.when(2 * F.col("p") > F.col("n"), 1).when(2 * F.col("p") < F.col("n"), 0)
    return counted.where(F.col("n") >= min_others).select("judge", "unit", "own", consensus.alias("consensus"))


def binary_metrics(pairs: DataFrame, *groups: str) -> DataFrame:
    """Agreement of ``own`` with ``consensus`` (1 is positive), with skipped ties counted."""
    own, c = F.col("own"), F.col("consensus")
    counts = pairs.groupBy(*groups).agg(
        F.count_if((own == 1) & (c == 1)).alias("tp"), F.count_if((own == 0) & (c == 0)).alias("tn"),
        F.count_if((own == 1) & (c == 0)).alias("fp"), F.count_if((own == 0) & (c == 1)).alias("fn"),
        F.count_if(c.isNull()).alias("n_ties"),
    )
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    accuracy, precision, recall = F.try_divide(tp + tn, n), F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    out = {
        "accuracy": accuracy, "sensitivity": recall, "specificity": F.try_divide(tn, tn + fp), "precision": precision,
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "kappa": F.try_divide(accuracy - chance, 1 - chance),
    }
    return counts.select(*groups, n.cast("long").alias("n"), "n_ties", *(F.round(v, 6).alias(k) for k, v in out.items()))


def leave_one_out_scores(ratings: DataFrame, min_others: int = 2) -> DataFrame:
    """judge, unit, own, consensus: each score beside the low median of the others' scores.

    A unit's scores are one small sorted array (there are few judges); a
    judge's own score is taken out of it.
    """
    usable = ratings.where(F.col("score").between(1, 5))
    units = usable.groupBy("unit").agg(
        F.sort_array(F.collect_list("score")).alias("all"), F.collect_list(F.struct("judge", "score")).alias("rows")
    ).where(F.size("all") > min_others)
    each = units.select("unit", "all", F.explode("rows").alias("r"))
    # leaving out one value at or before the middle moves the median one place on
    place = F.array_position("all", F.col("r.score")).cast("int")
    middle = F.floor((F.size("all") - 2) / 2).cast("int") + 1
    consensus = F.element_at("all", F.when(place <= middle, middle + 1).otherwise(middle))
    return each.select("r.judge", "unit", F.col("r.score").alias("own"), consensus.alias("consensus"))


def ordinal_metrics(pairs: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Exact matches, mean absolute and squared error, Spearman's rho and quadratic weighted kappa per group.

    All are sums over the k by k confusion counts.  Rho is null where either
    side does not vary, kappa where no disagreement is expected.
    """
    inside = F.col("own").between(1, k) & F.col("consensus").between(1, k)
    cells = pairs.where(inside).groupBy(group, "own", "consensus").agg(F.count("*").alias("c"))
    side = lambda name: Window.partitionBy(group, name)
    rows = cells.withColumn("row", F.sum("c").over(side("own"))).withColumn("col", F.sum("c").over(side("consensus")))
    by = lambda name: Window.partitionBy(group).orderBy(name).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda name: F.sum("c").over(by(name))
    rows = rows.withColumn("ra", upto("own") - (F.col("row") - 1) / 2).withColumn("rb", upto("consensus") - (F.col("col") - 1) / 2)
    c, d = F.col("c"), F.col("own") - F.col("consensus")
    s = rows.groupBy(group).agg(
        F.sum("c").alias("n"), F.sum(F.when(d == 0, c).otherwise(0)).alias("same"), F.sum(c * F.abs(d)).alias("ad"),
        F.sum(c * d * d).alias("sd"), F.sum(c * F.col("ra")).alias("sa"), F.sum(c * F.col("rb")).alias("sb"),
        F.sum(c * F.col("ra") * F.col("ra")).alias("saa"), F.sum(c * F.col("rb") * F.col("rb")).alias("sbb"),
        F.sum(c * F.col("ra") * F.col("rb")).alias("sab"),
        F.sum(c * F.col("own")).alias("so"), F.sum(c * F.col("consensus")).alias("sc"),
        F.sum(c * F.col("own") * F.col("own")).alias("soo"), F.sum(c * F.col("consensus") * F.col("consensus")).alias("scc"),
    )
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    rho = F.when((va > 0) & (vb > 0), (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb))
    # expected squared difference of independent draws from the two margins
    expected = (F.col("soo") + F.col("scc")) / n - 2 * (F.col("so") / n) * (F.col("sc") / n)
    kappa = 1 - F.try_divide(F.col("sd") / n, expected)
    out = {"exact": F.col("same") / n, "mae": F.col("ad") / n, "mse": F.col("sd") / n, "spearman": rho, "weighted_kappa": kappa}
    return s.select(group, "n", *(F.round(v, 6).alias(name) for name, v in out.items()))
