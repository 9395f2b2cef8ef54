"""Models with random effects over 0/1 outcomes, from counts.

The mixed logistic regression integrates the effects of quizzes and of their
questions by Laplace's approximation.  Questions of a quiz with the same
outcomes are one pattern with a count, a quiz is one row, and one Spark job
gives the likelihood at all parameter vectors that a step of the search needs;
the search itself has a few numbers on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridict.operators.stats import Z, chi_square_tail

#: Bounds of the logarithm of a standard deviation: below the lower one an effect counts as absent.
LEAST_LOG, MOST_LOG = -6.0, 3.0


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """quiz, seen, n: the outcomes (llm, y) of a quiz's questions, each with the number of questions that have them.

    ``attempts`` has quiz, item, llm, y; of repeated attempts the greatest y
    counts, a null quiz is one of its own.  At most 3^llms rows a quiz, however
    many attempts there are.
    """
    quiz = F.coalesce(F.col("quiz").cast("string"), F.lit("")).alias("quiz")
    own = attempts.where(F.col("y").isNotNull()).groupBy(quiz, "item", "llm").agg(F.max("y").cast("int").alias("y"))
    seen = F.sort_array(F.collect_list(F.struct("llm", "y"))).alias("seen")
    return own.groupBy("quiz", "item").agg(seen).groupBy("quiz", "seen").agg(F.count("*").alias("n"))


def pattern_counts(attempts: DataFrame, llms: list) -> DataFrame:
    """quiz, patterns: for each quiz its questions' outcomes by llm (1, 0, or -1 where there is none) with their numbers."""
    return _patterns(outcome_counts(attempts), llms)


def _patterns(outcomes: DataFrame, llms: list) -> DataFrame:
    cell = lambda v: F.coalesce(F.get(F.filter("seen", lambda e: e["llm"] == v), F.lit(0))["y"], F.lit(-1))
    counts = outcomes.groupBy("quiz", F.array(*map(cell, llms)).alias("y")).agg(F.sum("n").alias("n"))
    return counts.groupBy("quiz").agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("patterns"))  # at most 3^llms entries


def _modes(y: np.ndarray, n: np.ndarray, beta: np.ndarray, quiz: float, item: float) -> float:
    """Laplace's log likelihood of one quiz: Newton steps to the joint mode of its effect and its questions'."""
    seen, hit = y >= 0, np.where(y > 0, 1.0, 0.0)
    b, a = 0.0, np.zeros(len(n))

    def value(b: float, a: np.ndarray) -> float:
        eta = beta + b + a[:, None]
        fit = np.where(seen, hit * eta - np.logaddexp(0.0, eta), 0.0).sum(axis=1)
        return float(n @ (fit - a * a / (2 * item**2)) - b * b / (2 * quiz**2))

    now = value(b, a)
    for _ in range(100):
        mu = 1 / (1 + np.exp(-(beta + b + a[:, None])))
        g, w = np.where(seen, hit - mu, 0.0).sum(axis=1), np.where(seen, mu * (1 - mu), 0.0).sum(axis=1)
        h, ga = w + 1 / item**2, g - a / item**2
        schur = n @ (w - w * w / h) + 1 / quiz**2
        db = (n @ g - b / quiz**2 - n @ (w * ga / h)) / schur
        da, step = (ga - w * db) / h, 1.0
        while (then := value(b + step * db, a + step * da)) < now - 1e-12 and step > 1e-6:
            step /= 2
        b, a, gain, now = b + step * db, a + step * da, then - now, then
        if abs(gain) < 1e-12 * (1 + abs(now)):
            break
    mu = 1 / (1 + np.exp(-(beta + b + a[:, None])))
    w = np.where(seen, mu * (1 - mu), 0.0).sum(axis=1)
    h = w + 1 / item**2
    schur = n @ (w - w * w / h) + 1 / quiz**2
    return now - (n @ np.log(h * item**2) + math.log(schur * quiz**2)) / 2


def laplace(patterns: DataFrame, points: list[np.ndarray], columns: int) -> np.ndarray:
    """Log likelihood at each point: fixed effects (one for all llms, or one each), then logs of both standard deviations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(points))
        for batch in batches:
            for rows in batch["patterns"]:
                y, n = np.array([list(r["y"]) for r in rows]), np.array([float(r["n"]) for r in rows])
                for k, p in enumerate(points):
                    beta = p[:-2] if len(p) > 3 or columns == 1 else np.full(columns, p[0])
                    total[k] += _modes(y, n, beta, math.exp(p[-2]), math.exp(p[-1]))
        yield pd.DataFrame({"k": np.arange(len(points)), "v": total})

    rows = patterns.select("patterns").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])


def _bounded(p: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip(p[:-2], -20, 20), np.clip(p[-2:], LEAST_LOG, MOST_LOG)])


def _search(patterns: DataFrame, start: np.ndarray, columns: int, steps: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum by Newton steps on numeric derivatives; also the curvature there.  A step is two jobs."""
    p, h, size = _bounded(start), 1e-3, len(start)
    now, damp = float(laplace(patterns, [p], columns)[0]), 1e-3
    pairs = [(i, j) for i in range(size) for j in range(i)]
    eye = np.eye(size) * h
    for _ in range(steps):
        around = [p + e for e in eye] + [p - e for e in eye] + [p + eye[i] + eye[j] for i, j in pairs]
        at = laplace(patterns, around, columns)
        up, down = at[:size], at[size : 2 * size]
        slope, curve = (up - down) / (2 * h), np.diag((up + down - 2 * now) / h**2)
        for (i, j), both in zip(pairs, at[2 * size :], strict=True):
            curve[i, j] = curve[j, i] = (both - up[i] - up[j] + now) / h**2
        # a deviation at its lower bound that should fall further is held
        held = np.array([k >= size - 2 and p[k] <= LEAST_LOG + h and slope[k] < 1e-3 for k in range(size)])
        free = np.flatnonzero(~held)
        values, vectors = np.linalg.eigh(-curve[np.ix_(free, free)])
        trials = []
        for d in (damp, 10 * damp, 100 * damp, 1e3 * damp, 1e4 * damp):
            move = np.zeros(size)
            move[free] = vectors @ ((vectors.T @ slope[free]) / (np.maximum(np.abs(values), 1e-6) + d))
            trials += [_bounded(p + s * np.clip(move, -2, 2)) for s in (1.0, 0.3)]
        found = laplace(patterns, trials, columns)
        best = int(found.argmax())
        gain = float(found[best]) - now
        if gain > 0:
            p, now = trials[best], float(found[best])
        if gain < 1e-8:
            return p, now, curve
    raise ArithmeticError("the search did not settle")


@dataclass
class MixedLogistic:
    """Fixed effects by llm with their covariance, standard deviations of quizzes and questions, both log likelihoods and the test of no difference."""

    llms: list
    effects: np.ndarray
    covariance: np.ndarray
    quiz_sd: float
    item_sd: float
    log_likelihood: float
    null_log_likelihood: float

    @property
    def chi2(self) -> float:
        return 2 * (self.log_likelihood - self.null_log_likelihood)

    @property
    def p(self) -> float:
        return chi_square_tail(self.chi2, len(self.llms) - 1) if len(self.llms) > 1 else 1.0

    def means(self) -> list[tuple]:
        """(llm, logit, standard error, probability, its 95 % ends) at effects of zero."""
        at = lambda x: 1 / (1 + math.exp(-x))
        errors = np.sqrt(np.diag(self.covariance))
        return [(v, float(e), float(s), at(e), at(e - Z * s), at(e + Z * s)) for v, e, s in zip(self.llms, self.effects, errors, strict=True)]

    def pairs(self) -> list[tuple]:
        """(a, b, difference of logits, standard error, odds ratio, difference of probabilities, p, p by Holm's rule)."""
        at, out = 1 / (1 + np.exp(-self.effects)), []
        for i in range(len(self.llms)):
            for j in range(i + 1, len(self.llms)):
                d = float(self.effects[i] - self.effects[j])
                s = math.sqrt(self.covariance[i, i] + self.covariance[j, j] - 2 * self.covariance[i, j])
                out.append([self.llms[i], self.llms[j], d, s, math.exp(d), float(at[i] - at[j]), math.erfc(abs(d / s) / math.sqrt(2))])
        most = 0.0
        for rank, row in enumerate(sorted(out, key=lambda r: r[6])):
            most = max(most, min(1.0, (len(out) - rank) * row[6]))
            row.append(most)
        return [tuple(r) for r in out]


def mixed_logistic(attempts: DataFrame) -> MixedLogistic:
    """correct ~ llm + (1 | quiz) + (1 | quiz : item), and its comparison with the model without llms.

    ``attempts`` has quiz, item, llm and y (0 or 1); rows without y are left
    out.  Llms are few: they become columns of the patterns.
    """
    outcomes, patterns = outcome_counts(attempts).cache(), None
    try:  # the attempts are read once
        each = outcomes.select(F.explode("seen").alias("e"), "n").where("e.llm is not null")
        shares = {r["llm"]: r["m"] for r in each.groupBy("e.llm").agg((F.sum(F.col("e.y") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        if not shares:
            raise ValueError("no attempts")
        llms = sorted(shares)
        # quizzes lie in tasks of their own; adaptive execution would put the few rows into one
        patterns = _patterns(outcomes, llms).repartition(attempts.sparkSession.sparkContext.defaultParallelism).cache()
        logit = lambda m: math.log((m + 0.01) / (1.01 - m))
        m = len(llms)
        null, null_at, _ = _search(patterns, np.array([logit(sum(shares[v] for v in llms) / m), -0.5, 0.0]), m)
        start = np.array([*(null[0] + logit(shares[v]) - np.mean([logit(shares[x]) for x in llms]) for v in llms), *null[1:]])
        full, at, curve = _search(patterns, start, m) if m > 1 else (null, null_at, None)
        if curve is None:
            _, _, curve = _search(patterns, null, m, 3)
    finally:
        for table in (outcomes, patterns):
            if table is not None:
                table.unpersist()
    keep = [k for k in range(len(full)) if k < m or full[k] > LEAST_LOG + 0.01]
    covariance = np.linalg.inv(-curve[np.ix_(keep, keep)])[:m, :m]
    sd = [0.0 if v <= LEAST_LOG + 0.01 else math.exp(v) for v in full[-2:]]
    return MixedLogistic(llms, full[:m], covariance, *sd, at, null_at)


#: Nodes and weights of Gauss-Hermite quadrature, by rule.
NODES, WEIGHTS = (tuple(float(v) for v in part) for part in np.polynomial.hermite.hermgauss(15))
ROUNDS = 12


def _moments(rows: DataFrame) -> DataFrame:
    """Append m, q and p: mean and mean square of a cell's logit, and its mean probability, given a + b and s.

    Quadrature nodes lie around the normal approximation of the posterior, so
    they fit cells of few trials and of many.
    """
    prior = F.col("a") + F.col("b")
    placed = rows.withColumn("precision", F.col("w0") + 1 / (F.col("s") * F.col("s")))
    placed = placed.withColumn("centre", (F.col("w0") * F.col("t0") + prior / (F.col("s") * F.col("s"))) / F.col("precision"))
    offset = lambda t: (t - prior) * (t - prior) - (F.col("centre") - prior) * (F.col("centre") - prior)
    fit = lambda t: F.col("k") * (t - F.col("centre")) - F.col("n") * (F.log1p(F.exp(t)) - F.log1p(F.exp("centre")))
    node = lambda x, w: F.struct((F.col("centre") + F.sqrt(2 / F.col("precision")) * x).alias("t"), (w * F.exp(x * x)).alias("w"))
    nodes = F.zip_with(F.array(*map(F.lit, NODES)), F.array(*map(F.lit, WEIGHTS)), node)
    weighed = F.transform(nodes, lambda e: F.struct(e["t"].alias("t"), (e["w"] * F.exp(fit(e["t"]) - offset(e["t"]) / (2 * F.col("s") * F.col("s")))).alias("w")))
    total = lambda value: F.aggregate("nodes", F.lit(0.0), lambda x, e: x + e["w"] * value(e["t"]))
    sums = placed.withColumn("nodes", weighed).select(*rows.columns, total(lambda t: F.lit(1.0)).alias("_w"), *(
        total(f).alias(c) for c, f in (("m", lambda t: t), ("q", lambda t: t * t), ("p", lambda t: 1 / (1 + F.exp(-t))))
    ))
    return sums.withColumns({c: F.col(c) / F.col("_w") for c in ("m", "q", "p")}).drop("_w")


def partial_pooling(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """llm, topic, n, raw, pooled, low, high, shrinkage: accuracies by llm and topic, drawn towards what both lead to expect.

    ``cells`` has llm, topic, k (right) and n (tried), one row each.  The logit
    of a cell is normal around the sum of an effect of its topic and one of its
    llm, with one deviation; effects and deviation come from ``rounds`` of
    expectation-maximisation over the cells' posteriors, and the interval is
    that of a normal logit.  This is the empirical-Bayes counterpart of a fully
    Bayesian model: the uncertainty of the effects themselves is not carried.
    Cells without trials are left out.

    Only cells are moved, one row a llm and topic: windows by topic, by llm and
    over all of them make a round.
    """
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    share = (k + 0.5) / (n + 1)
    start = cells.where("n > 0").select("llm", "topic", k.alias("k"), n.alias("n"), F.ln(share / (1 - share)).alias("t0"), (n * share * (1 - share)).alias("w0"))
    state = start.withColumns({"a": F.lit(0.0), "b": F.avg("t0").over(Window.partitionBy("topic")), "s": F.lit(1.0)})
    for _ in range(rounds):
        state = _moments(state).drop("p")
        state = state.withColumn("b", F.avg(F.col("m") - F.col("a")).over(Window.partitionBy("topic")))
        state = state.withColumn("a", F.avg(F.col("m") - F.col("b")).over(Window.partitionBy("llm")))
        prior = F.col("a") + F.col("b")
        spread = F.col("q") - 2 * F.col("m") * prior + prior * prior
        state = state.withColumn("s", F.sqrt(F.avg(spread).over(Window.partitionBy()))).drop("m", "q")
    found = _moments(state)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))
    at = lambda t: 1 / (1 + F.exp(-t))
    return found.select(
        "llm", "topic", F.col("n").cast("long").alias("n"), (F.col("k") / F.col("n")).alias("raw"), F.col("p").alias("pooled"),
        at(F.col("m") - Z * sd).alias("low"), at(F.col("m") + Z * sd).alias("high"), (F.col("p") - F.col("k") / F.col("n")).alias("shrinkage"),
    )
