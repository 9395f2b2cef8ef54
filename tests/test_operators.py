"""Small fixtures for rules that the driver's tables do not reach."""

import math

import pytest
from pyspark.sql import functions as F

from veridict.functions import text as X
from veridict.operators import leaderboard, reliability, resample, stats, subset, topics, validity


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_labels(spark):
    assert column(spark, ["Allergy / Immunology", " Obstetrics & Gynecology ", "", None], X.normalize_label) == [
        "allergy immunology", "obstetrics and gynecology", "", None,
    ]
    assert column(spark, ["a/b", "a & b", "band"], X.is_combined_label) == [True, True, False]
    assert column(spark, ["\t a \n"], X.strip) == ["a"]


def test_answer_letters(spark):
    texts = ["The answer is (B).", "Answer: c", "(D)", "I think A or E", "answer is (Z)", "none", "", None]
    assert column(spark, texts, X.answer_letter) == ["B", "C", "D", "E", None, None, None, None]


def test_text_helpers(spark):
    assert column(spark, ["x ```json\n{\"a\": 1}\n``` y", "z [1, 2] w", "plain"], X.json_block) == ['{"a": 1}', "[1, 2]", "plain"]
    assert column(spark, ["“a”–b"], X.plain_punctuation) == ['"a"-b']
    assert column(spark, ["gpt-5", "Claude-x", "other"], X.provider_family) == ["openai", "anthropic", "other"]
    assert column(spark, ["95", "0.5", "x", "NaN"], X.fraction) == [0.95, 0.5, None, None]
    assert column(spark, ["a" * 80, "a b"], X.custom_id)[1] == "a-b" and len(column(spark, ["a" * 80], X.custom_id)[0]) == 64
    assert column(spark, [0.0, 0.125, 0.375, 1.0, 2.0], lambda v: X.heat_level(v, F.lit(0), F.lit(1)), "double") == [0, 0, 2, 4, 4]
    assert column(spark, [3, 0], X.option_letters, "int") == [["A", "B", "C"], []]
    assert column(spark, ["x_seed3_seed12", "none"], X.seed_of) == [12, None]


def test_topic_mapping_errors(spark):
    rows = spark.createDataFrame([("weird",)], "topic string")
    with pytest.raises(ValueError, match="told apart"):
        topics.check_categories(["A & B", "a and b"])
    with pytest.raises(Exception, match="no category"):
        topics.map_topics(rows, "topic", ["A"], unmapped="error").collect()
    assert topics.map_topics(rows, "topic", ["A"], misc="M", unmapped="misc").first().mapped == "M"


def test_response_topics(spark):
    rows = spark.createDataFrame([("Cardiology; other",), ("internal  MEDICINE\nbecause",), ("it is in cardiology",), ("?",), (None,)], "r string")
    got = topics.response_topic(rows, "r", ["Cardiology", "Internal Medicine"]).collect()
    assert [r.topic for r in got] == ["Cardiology", "Internal Medicine", "Cardiology", None, None]


def ratings(spark, rows):
    return spark.createDataFrame(rows, "unit long, judge int, verdict string, score int")


def test_alpha_edges(spark):
    agree = ratings(spark, [(u, j, "PASS" if u % 2 else "FAIL", 1 + u % 2) for u in range(6) for j in range(3)])
    value = lambda df, v, d: reliability.krippendorff(df, v, d).first()
    assert value(agree, "score", reliability.interval).alpha == 1.0 and value(agree, "verdict", reliability.nominal).alpha == 1.0
    same = ratings(spark, [(1, j, "PASS", 3) for j in range(3)])
    assert value(same, "score", reliability.interval).alpha == 1.0
    lone = ratings(spark, [(u, 1, "PASS", 3) for u in range(3)])
    assert value(lone, "score", reliability.interval) is None or value(lone, "score", reliability.interval).alpha is None


def test_leave_one_out(spark):
    r = ratings(spark, [(1, 1, "PASS", 1), (1, 2, "PASS", 2), (1, 3, "FAIL", 3), (1, 4, "FAIL", 4), (2, 1, "PASS", 5), (2, 2, "PASS", 5)])
    v = {(x.unit, x.judge): x.consensus for x in reliability.leave_one_out_verdicts(r).collect()}
    assert v == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1}
    s = {(x.unit, x.judge): x.consensus for x in reliability.leave_one_out_scores(r).collect()}
    assert s == {(1, 1): 3, (1, 2): 3, (1, 3): 2, (1, 4): 2}
    flat = spark.createDataFrame([("j", 3, 3), ("j", 3, 3)], "judge string, own int, consensus int")
    row = reliability.ordinal_metrics(flat, "judge").first()
    assert row.exact == 1.0 and row.spearman is None and row.weighted_kappa is None


def test_last_rating_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "b", 5), (1, 2, "c", 1)], "unit long, judge int, v string, at int")
    assert {(r.judge, r.v) for r in reliability.last_rating(rows, "at").collect()} == {(1, "b"), (2, "c")}


def test_wilson_and_tails(spark):
    rows = spark.createDataFrame([("a", 0)] * 3 + [("b", 1)] * 3, "k string, y int")
    got = {r.k: (r.low, r.high) for r in stats.proportions(rows, "y", "k").collect()}
    assert got["a"][0] == 0.0 and got["b"][1] == 1.0
    assert stats.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(10.892, 5) == pytest.approx(0.05356, abs=1e-4)
    dof = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 10, 30)], "d int").select("d", stats.t_quantile(F.col("d")).alias("t")).collect()
    want = {1: 12.7062, 2: 4.30265, 3: 3.18245, 10: 2.22814, 30: 2.04227}
    assert dof[0].t is None and all(r.t == pytest.approx(want[r.d], abs=1e-5) for r in dof[1:])
    e = spark.range(1).select(stats.erfc(F.lit(1.0)).alias("e")).first().e
    assert e == pytest.approx(math.erfc(1.0), abs=3e-7)


def test_cutoffs_are_monotone(spark):
    rows = [(f"r{u % 3}", u, j, "g", "PASS" if (u * j) % 3 else "FAIL", 1 + (u + j) % 5, True) for u in range(60) for j in range(1, 6)]
    r = spark.createDataFrame(rows, "run_id string, unit long, judge int, generator string, verdict string, score int, output_valid boolean")
    kept = {x.cutoff: x.n_kept for x in validity.kept_by_cutoff(r, [3, 4, 5]).collect()}
    assert kept.get(3, 0) >= kept.get(4, 0) >= kept.get(5, 0)


def test_interleave_is_a_permutation(spark):
    rows = [(k, "g", "AB"[k % 2]) for k in range(20)]
    candidates = spark.createDataFrame(rows, "question_id long, generator string, category string")
    targets = spark.createDataFrame([("A", 3, 0), ("B", 2, 1)], "category string, target int, ord int")
    picked = subset.select_quota(candidates, targets, ["question_id"], "generator")
    mixed = subset.interleave(picked, "generator").orderBy("index").collect()
    assert [r.question_id for r in mixed] == [0, 1, 2, 3, 4] and [r["index"] for r in mixed] == list(range(5))
    assert subset.shortfall(candidates, targets.select("category", "target"), "generator").count() == 0


def test_pareto_ties(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.6), ("c", 2.0, 0.6), ("d", 3.0, 0.7)], "model string, cost double, acc double")
    assert {r.model for r in leaderboard.pareto_frontier(rows).collect()} == {"b", "d"}


def test_resampling(spark):
    rows = [(i, l, int((i + l) % 3 > 0), f"t{i % 4}", f"q{i % 2}") for i in range(60) for l in (1, 2)]
    attempts = spark.createDataFrame(rows, "item long, llm int, y int, topic string, quiz string")
    reps = resample.paired_bootstrap(attempts, 300, seed=1)
    ends = {r.llm: r for r in resample.percentile_interval(reps, "mean", "llm").collect()}
    assert all(r.low <= 2 / 3 <= r.high and r.high - r.low < 0.35 for r in ends.values())
    again = resample.paired_bootstrap(attempts.repartition(3), 300, seed=1)
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, again.collect()))
    (diff,) = resample.pairwise_differences(reps).collect()
    assert diff.low <= 0 <= diff.high
    items = attempts.where("llm = 1").select("item", F.col("y").alias("value"), "topic", F.col("quiz").alias("stratum"))
    p = resample.topic_permutation(items, 200).first()
    assert 0 < p.p_perm <= 1
    r = spark.createDataFrame([(u, j, "PASS" if u % 2 else "FAIL") for u in range(40) for j in range(3)], "unit long, judge int, verdict string")
    assert {x.alpha for x in resample.alpha_bootstrap(r, "verdict", iterations=50).collect()} == {1.0}
    ends = resample.proportion_bootstrap(spark.createDataFrame([("a", 30, 40)], "key string, c long, n long")).first()
    assert ends.low < 0.75 < ends.high


def test_resampling_agrees_with_other_generators(spark):
    """Spreads and p-values are those of draws item by item."""
    import numpy as np

    random = np.random.default_rng(2)
    n = 3000
    topic, stratum = random.integers(0, 3, n), random.integers(0, 2, n) * (np.arange(n) > 2400)
    y = (random.random((n, 2)) < 0.6 + 0.02 * topic[:, None]).astype(int)
    rows = [(i, l + 1, int(y[i, l])) for i in range(n) for l in range(2)]
    reps = resample.paired_bootstrap(spark.createDataFrame(rows, "item long, llm int, y int"), 400)
    for r in reps.groupBy("llm").agg(F.avg("mean").alias("m"), F.stddev("mean").alias("s")).collect():
        share = y[:, r.llm - 1].mean()
        error = (share * (1 - share) / n) ** 0.5
        assert abs(r.m - share) < 5 * error / 20 and 0.8 < r.s / error < 1.2
    value = y.mean(1)
    items = spark.createDataFrame([(i, float(value[i]), f"t{topic[i]}", f"q{stratum[i]}") for i in range(n)], "item long, value double, topic string, stratum string")

    def between(labels):
        return sum(value[labels == t].sum() ** 2 / (labels == t).sum() for t in range(3))

    def permuted():
        labels = topic.copy()
        for s in range(2):
            labels[stratum == s] = random.permutation(labels[stratum == s])
        return labels

    least, inner = between(topic), np.array([between(permuted()) for _ in range(1000)])
    f = ((least - value.sum() ** 2 / n) / 2) / (((value**2).sum() - least) / (n - 3))
    got = resample.topic_permutation(items, 500).first()
    assert abs(got.f - f) < 1e-6 and abs(got.p_perm - (inner >= least - 1e-9).mean()) < 0.1
    assert got == resample.topic_permutation(items.repartition(5), 500).first()
