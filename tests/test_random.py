"""Counter-based draws, and special functions against direct sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridict.functions import random as R
from veridict.functions import special as S
from veridict.operators import resample, stats


@pytest.fixture(scope="module")
def draws(spark):
    items = spark.range(400).select(F.col("id").alias("item"), F.lit("x").alias("z"))
    return R.drawn(items.repartition(3), ["item"], 300, seed=5).withColumn("w", R.poisson("z"))


def test_draws_are_uniform_and_independent_of_partitions(spark, draws):
    z = draws.toPandas().pivot(index="item", columns="replicate", values="z").to_numpy() / R.P
    assert abs(z.mean() - 0.5) < 0.005 and abs(z.std() - 12**-0.5) < 0.005
    between = np.corrcoef(z)
    assert abs(between[np.triu_indices(400, 1)]).mean() < 2 / 300**0.5 and abs(np.corrcoef(z.T)[np.triu_indices(300, 1)]).max() < 0.4
    again = R.drawn(spark.range(399, -1, -1).select(F.col("id").alias("item")).coalesce(1), ["item"], 300, seed=5)
    assert draws.agg(F.sum(F.col("z") * F.col("replicate"))).first() == again.agg(F.sum(F.col("z") * F.col("replicate"))).first()


def test_poisson_weights(draws):
    counts = {r.w: r["count"] / 120_000 for r in draws.groupBy("w").count().collect()}
    for k in range(5):
        assert abs(counts[k] - math.exp(-1) / math.factorial(k)) < 0.004
    total = draws.groupBy("replicate").agg(F.sum("w").alias("n")).agg(F.stddev("n")).first()[0]
    assert 17 < total < 23  # the standard deviation of 400 independent ones is 20


def test_poisson_limits():
    upto = 0
    for k, limit in enumerate(R.POISSON):
        upto += 1 / math.factorial(k)
        assert abs(limit - R.P * upto / math.e) < 2


def test_null_keys_are_a_value(spark):
    rows = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None)], "x string, y string").select(*R.item_keys("x", "y"))
    assert len({(r.k1, r.k2) for r in rows.collect()}) == 3


def test_gamma_and_beta(spark):
    rows = [(float(x), d) for x in (0.0, 0.1, 3.84, 10.892, 50.0, 900.0) for d in (0, 1, 2, 5, 30, 200, 1000)]
    for r in spark.createDataFrame(rows, "x double, d int").withColumn("p", S.chi_square_p(F.col("x"), F.col("d"))).collect():
        assert r.p is None if r.d == 0 else abs(r.p - stats.chi_square_tail(r.x, r.d)) < 1e-11
    x = spark.createDataFrame([(v,) for v in (0.01, 0.5, 1.0, 7.3, 1e4)], "x double").withColumn("g", S.log_gamma(F.col("x")))
    assert all(abs(r.g - math.lgamma(r.x)) < 1e-12 * max(1, abs(r.g)) for r in x.collect())
    # tabulated points of chi-square and of the normal tail
    points = spark.createDataFrame([(3.841459, 1, 0.05), (11.070498, 5, 0.05), (16.811894, 6, 0.01), (10.892, 5, 0.05356)], "x double, d int, p double")
    assert all(abs(r.q - r.p) < 1e-5 for r in points.withColumn("q", S.chi_square_p(F.col("x"), F.col("d"))).collect())


def quantile(q, n, p):
    upto = 0.0
    for k in range(n + 1):
        upto += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if upto >= q:
            return k
    return n


def test_binomial_quantiles(spark):
    rows = [(f"{n}/{c}", c, n) for n in (1, 2, 10, 40, 300) for c in sorted({0, 1, n // 2, n - 1, n})] + [("none", 0, 0)]
    for r in resample.proportion_interval(spark.createDataFrame(rows, "key string, c long, n long")).collect():
        if r.n:
            assert (r.low, r.high) == (quantile(0.025, r.n, r.c / r.n) / r.n, quantile(0.975, r.n, r.c / r.n) / r.n), r
        else:
            assert r.low is None and r.high is None


def test_ranks_in_buckets(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"t{i % 3}", None if i % 10 else "rare", float(i % 7)) for i in range(500)], "item long, topic string, stratum string, value double")
    whole = resample.topic_permutation(items, 60).first()
    monkeypatch.setattr(resample, "ROWS_A_BUCKET", 20)
    assert resample.topic_permutation(items.repartition(5), 60).first() == whole


def test_permutation_in_arrays(spark, monkeypatch):
    """Strata held as arrays and strata ranked as rows give the same p, also with nulls; arrays never multiply rows by replicates."""
    rows = [(i if i % 50 else None, f"t{i % 3}" if i % 11 else None, "rare" if i % 10 else None, float(i % 7) if i % 13 else None) for i in range(400)]
    items = spark.createDataFrame(rows, "item long, topic string, stratum string, value double")
    calls, plain = [], resample.drawn
    monkeypatch.setattr(resample, "drawn", lambda *a, **b: calls.append(a) or plain(*a, **b))
    whole = resample.topic_permutation(items, 60).first()
    assert not calls
    for held in (100, 0):  # one stratum as rows, then both
        monkeypatch.setattr(resample, "ITEMS_HELD", held)
        assert resample.topic_permutation(items.repartition(3), 60).first() == whole
    assert calls


def test_undefined_resampling(spark):
    items = spark.createDataFrame([(1, "a", "s", 1.0), (2, "a", "s", 1.0)], "item long, topic string, stratum string, value double")
    got = resample.topic_permutation(items, 10).first()
    assert got.f is None and abs(got.p_perm - 1 / 11) < 1e-6
    none = spark.createDataFrame([(1, 1, 0), (2, 2, 1)], "item long, llm int, y int")
    assert resample.paired_bootstrap(none, 10).count() == 0
    assert resample.paired_bootstrap(none.where("false"), 10).count() == 0
    empty = resample.topic_bootstrap(items.where("false"), 10).collect()
    assert [tuple(r) for r in empty] == [("RANGE", 0, None, None, None)]


def brute_chi_square(cells):
    rows, columns = {r for r, _ in cells}, {c for _, c in cells}
    n = sum(cells.values())
    expected = {(r, c): sum(v for (x, _), v in cells.items() if x == r) * sum(v for (_, y), v in cells.items() if y == c) / n for r in rows for c in columns}
    gaps = {k: abs(cells.get(k, 0) - e) for k, e in expected.items()}
    if (len(rows) - 1) * (len(columns) - 1) == 1:
        gaps = {k: g - min(0.5, g) for k, g in gaps.items()}
    return sum(g * g / expected[k] for k, g in gaps.items()), min(expected.values())


@pytest.mark.parametrize("cells", [
    {("a", "x"): 5, ("a", "y"): 7, ("b", "x"): 9, ("b", "y"): 1}, {("a", "x"): 5, ("b", "y"): 8}, {("a", "x"): 3, ("a", "z"): 2, ("b", "y"): 4, ("c", "x"): 1},
    {("a", "x"): 10, ("a", "y"): 10, ("b", "x"): 10, ("b", "y"): 10},
])
def test_chi_square_without_absent_cells(spark, cells):
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()] + [("never", "never", 0)], "r string, c string, n long")
    got, (chi2, least) = stats.chi_square(table, "r", "c").first(), brute_chi_square(cells)
    assert abs(got.chi2 - chi2) < 1e-6 and abs(got.min_expected - least) < 1e-6
    assert abs(got.p - stats.chi_square_tail(chi2, got.dof)) < 1e-6


def test_weights_on_arrays(spark):
    """Weights that tasks make on arrays are those of the columns; draws are not rows of the plan."""
    import numpy as np

    from veridict.functions import random as R
    from veridict.operators import resample

    items = spark.createDataFrame([(k,) for k in range(200)], "unit long")
    rows = R.drawn(items, ["unit"], 60, 5).withColumn("w", R.poisson("z")).collect()
    want = {(r.replicate, r.unit): r.w for r in rows}
    keys = items.select("unit", *R.item_keys("unit")).collect()
    c = R.replicates(spark, 60, 5).orderBy("replicate").collect()
    coefficients = np.array([[r[x] for r in c] for x in ("ca", "cb", "cc", "cd")], dtype=np.int64)[:, :, None]
    w = resample._taken(coefficients, np.array([k.k1 for k in keys]), np.array([k.k2 for k in keys]), np.array(R.POISSON, dtype=np.int32))
    assert {(b, k.unit): w[b, i] for b in range(60) for i, k in enumerate(keys)} == want
    edge = np.array([0, R.P - 1], dtype=np.int64)
    same = resample._taken(np.array([[[R.P - 1]]] * 4, dtype=np.int64), edge, edge, np.array(R.POISSON, dtype=np.int32))
    z = [(((R.P - 1) * int(k) + R.P - 1) % R.P * int(k) + (R.P - 1) * int(k) + R.P - 1) % R.P for k in edge]
    assert same[0].tolist() == [sum(x >= limit for limit in R.POISSON) for x in z]
    ratings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "unit long, v string")
    plan = resample.alpha_bootstrap(ratings, "v", iterations=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "Generate explode" not in plan
