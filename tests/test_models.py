"""Mixed and pooled models against direct computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridict.operators import models as M


def laplace_directly(rows, beta, quiz_sd, item_sd):
    """Log likelihood by Newton steps over all effects of a quiz at once, with the full matrix of second derivatives."""
    total = 0.0
    for q in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == q]
        items = sorted({r[1] for r in own})
        z = np.zeros((len(own), 1 + len(items)))
        z[:, 0] = 1
        for i, r in enumerate(own):
            z[i, 1 + items.index(r[1])] = 1
        y, x = np.array([r[3] for r in own]), np.array([beta[r[2]] for r in own])
        prior, u = np.diag([1 / quiz_sd**2] + [1 / item_sd**2] * len(items)), np.zeros(1 + len(items))
        for _ in range(200):
            mu = 1 / (1 + np.exp(-(x + z @ u)))
            hessian = z.T @ (z * (mu * (1 - mu))[:, None]) + prior
            u = u + np.linalg.solve(hessian, z.T @ (y - mu) - prior @ u)
        eta = x + z @ u
        total += y @ eta - np.logaddexp(0, eta).sum() - u @ prior @ u / 2 - (np.linalg.slogdet(hessian)[1] - np.linalg.slogdet(prior)[1]) / 2
    return total


def simulated(seed, quizzes=6, items=8, llms=3, quiz_sd=0.6, item_sd=1.0):
    rng = np.random.default_rng(seed)
    effect = np.linspace(0.5, 1.5, llms)
    rows = []
    for q in range(quizzes):
        b = rng.normal(0, quiz_sd)
        for i in range(items):
            a = rng.normal(0, item_sd)
            rows += [(f"q{q}", q * 100 + i, m, int(rng.random() < 1 / (1 + math.exp(-(effect[m] + a + b))))) for m in range(llms) if rng.random() < 0.9]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "quiz string, item long, llm int, y int").repartition(3)


def test_likelihood_is_that_of_the_full_matrix(spark):
    rows = simulated(1)
    patterns = M.pattern_counts(table(spark, rows), [0, 1, 2])
    points = [np.array([0.2, 0.9, 1.4, math.log(0.5), math.log(1.2)]), np.array([0.7, math.log(0.9), math.log(0.3)]), np.array([1.0, 1.0, 1.0, -5.0, -5.0])]
    want = [laplace_directly(rows, (p[:-2] if len(p) > 3 else np.full(3, p[0])), math.exp(p[-2]), math.exp(p[-1])) for p in points]
    assert np.allclose(M.laplace(patterns, points, 3), want, atol=1e-7)


def test_maximum_and_test_of_no_difference(spark):
    """At the maximum no nearby point is better, by the direct likelihood."""
    rows = simulated(2, quizzes=8, items=12)
    model = M.mixed_logistic(table(spark, [*rows, ("q0", 999, 0, None)]))
    best = laplace_directly(rows, model.effects, max(model.quiz_sd, math.exp(-6)), max(model.item_sd, math.exp(-6)))
    assert abs(best - model.log_likelihood) < 1e-5 and model.null_log_likelihood < model.log_likelihood
    for k, step in itertools.product(range(3), (-0.02, 0.02)):
        moved = model.effects.copy()
        moved[k] += step
        assert laplace_directly(rows, moved, max(model.quiz_sd, math.exp(-6)), max(model.item_sd, math.exp(-6))) < best
    for factor in (0.95, 1.05):
        assert laplace_directly(rows, model.effects, max(model.quiz_sd, math.exp(-6)), model.item_sd * factor) < best + 1e-7
    assert 0 < model.p < 1 and len(model.pairs()) == 3
    p, adjusted = [r[6] for r in model.pairs()], [r[7] for r in model.pairs()]
    assert all(a >= b for a, b in zip(adjusted, p, strict=True)) and min(adjusted) == pytest.approx(min(1, 3 * min(p)))


def test_no_effects_of_quizzes_and_items(spark):
    """Without variation between quizzes and items it is the plain regression: likelihoods of shares."""
    rows = [(f"q{i % 5}", i, m, int((i * 7 + m * 3) % 10 < 6 + m)) for i in range(60) for m in range(2)]
    model = M.mixed_logistic(table(spark, rows))
    share = [np.mean([r[3] for r in rows if r[2] == m]) for m in range(2)]
    plain = sum(60 * (s * math.log(s) + (1 - s) * math.log(1 - s)) for s in share)
    assert model.log_likelihood >= plain - 1e-6
    if model.item_sd == 0 and model.quiz_sd == 0:
        assert model.log_likelihood == pytest.approx(plain, abs=1e-3)


def test_attempts_are_read_once(spark):
    """However many steps the search takes, the attempts are made once."""
    rows = simulated(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    model = M.mixed_logistic(table(spark, rows).mapInArrow(counted, "quiz string, item long, llm int, y int"))
    assert read.value == len(rows) and model.llms == [0, 1, 2]


def test_outcomes_with_repeats_and_gaps(spark):
    """Of repeated attempts the greatest counts; a missing llm is -1, one without a name counts for none."""
    rows = [("q", 1, 0, 0), ("q", 1, 0, 1), ("q", 1, 1, 0), ("q", 2, 0, 1), ("q", 2, 1, 0), ("q", 3, 1, 1), ("q", 3, None, 1), (None, 1, 1, 1), ("q", 4, 0, None)]
    found = {r.quiz: [(list(p.y), p.n) for p in r.patterns] for r in M.pattern_counts(table(spark, rows), [0, 1]).collect()}
    assert found == {"q": [([-1, 1], 1), ([1, 0], 2)], "": [([-1, 1], 1)]}


def pooled_directly(cells, rounds):
    """The same expectation-maximisation with a fine grid instead of quadrature."""
    grid = np.linspace(-12, 12, 24001)
    llms, topics = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    start = {c: math.log((k + 0.5) / (n - k + 0.5)) for c, (k, n) in cells.items()}
    a, s = dict.fromkeys(llms, 0.0), 1.0
    b = {t: np.mean([v for c, v in start.items() if c[1] == t]) for t in topics}

    def moments():
        out = {}
        for (l, t), (k, n) in cells.items():
            w = k * grid - n * np.logaddexp(0, grid) - (grid - a[l] - b[t]) ** 2 / (2 * s * s)
            w = np.exp(w - w.max())
            out[l, t] = tuple((w @ f) / w.sum() for f in (grid, grid**2, 1 / (1 + np.exp(-grid))))
        return out

    for _ in range(rounds):
        m = moments()
        b = {t: np.mean([v[0] - a[c[0]] for c, v in m.items() if c[1] == t]) for t in topics}
        a = {l: np.mean([v[0] - b[c[1]] for c, v in m.items() if c[0] == l]) for l in llms}
        s = math.sqrt(np.mean([v[1] - 2 * v[0] * (a[c[0]] + b[c[1]]) + (a[c[0]] + b[c[1]]) ** 2 for c, v in m.items()]))
    return moments()


def test_pooling_against_a_grid(spark):
    rng = np.random.default_rng(4)
    cells = {(l, t): (int(k), n) for l, t in itertools.product(range(3), "abcd") for n in [int(rng.choice([1, 3, 10, 40, 2000]))] for k in [rng.binomial(n, rng.uniform(0.4, 1.0))]}
    rows = [(l, t, k, n) for (l, t), (k, n) in cells.items()] + [(9, "none", 0, 0)]
    found = {(r.llm, r.topic): r for r in M.partial_pooling(spark.createDataFrame(rows, "llm int, topic string, k long, n long"), 4).collect()}
    want = pooled_directly(cells, 4)
    assert found.keys() == cells.keys()
    for c, (m, q, p) in want.items():
        r, (k, n) = found[c], cells[c]
        assert abs(r.pooled - p) < 2e-4 and abs(r.raw - k / n) < 1e-12 and r.low < r.pooled < r.high
        assert abs(math.log(r.low / (1 - r.low)) - (m - 1.96 * math.sqrt(q - m * m))) < 0.02
    small, large = found[min(cells, key=lambda c: cells[c][1])], found[max(cells, key=lambda c: cells[c][1])]
    assert abs(large.shrinkage) < 0.01 and small.high - small.low > large.high - large.low


def test_nothing_to_model(spark):
    empty = table(spark, [("q", 1, 1, 1)]).where("false")
    with pytest.raises(ValueError, match="no attempts"):
        M.mixed_logistic(empty)
    assert M.partial_pooling(empty.groupBy("llm", F.col("quiz").alias("topic")).agg(F.sum("y").alias("k"), F.count("y").alias("n")), 1).count() == 0
