"""Agreement between judges, with resampled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.functions.random import SQL_DRAW, SQL_POISSON, P, sql_bits, sql_replicates
from veridict.operators import reliability as R
from veridict.operators import resample as B
from veridict.plans import query
from veridict.sources.tables import SQL_RATINGS, ratings


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where("output_valid").withColumn("pass", (F.col("verdict") == "PASS").cast("int"))


_VALID = f"{SQL_RATINGS}, valid AS (SELECT *, (verdict = 'PASS')::INT AS pass FROM ratings WHERE output_valid)"


def _alpha(value: str, distance: str) -> str:
    return f"""WITH {_VALID}, c AS (SELECT generator, unit, {value} AS v, count(*) AS c FROM valid GROUP BY 1, 2, 3),
u AS (SELECT * FROM c JOIN (SELECT generator, unit, sum(c) AS n FROM c GROUP BY 1, 2 HAVING sum(c) > 1) USING (generator, unit)),
o AS (SELECT a.generator, sum(a.c * b.c * {distance} / (a.n - 1.0)) AS o FROM u a JOIN u b USING (generator, unit) GROUP BY 1),
m AS (SELECT generator, v, sum(c) AS c FROM u GROUP BY 1, 2),
e AS (SELECT a.generator, sum(a.c * b.c * {distance}) AS e FROM m a JOIN m b USING (generator) GROUP BY 1),
t AS (SELECT generator, sum(c) AS n FROM u GROUP BY 1)
SELECT generator, round(1 - (o / n) / (e / (n * (n - 1.0))), 6) AS alpha, n::BIGINT AS n_pairable
FROM t JOIN o USING (generator) JOIN e USING (generator)"""


@query(_alpha("pass", "(a.v <> b.v)::INT"))
def alpha_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.krippendorff(_valid(spark, sf_dir), "pass", R.nominal, "generator")


@query(_alpha("score", "(a.v - b.v) * (a.v - b.v)"))
def alpha_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.krippendorff(_valid(spark, sf_dir), "score", R.interval, "generator")


@query(f"""WITH {_VALID}, k AS (SELECT generator, unit, count(DISTINCT judge) AS k FROM valid GROUP BY 1, 2)
SELECT generator, count(*) AS n_units, count(*) FILTER (k >= 2) AS n_units_2plus, count(*) FILTER (k = 7) AS n_complete,
       round(avg(k), 6) AS avg_raters FROM k GROUP BY 1""")
def reliability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reliability_counts(_valid(spark, sf_dir), "pass", 7, "generator")


@query(f"""WITH {_VALID}, k AS (SELECT generator, unit, count(*) AS n_raters, count(*) FILTER (verdict = 'PASS') AS n_pass FROM valid GROUP BY 1, 2)
SELECT generator, n_raters, n_pass, count(*) AS n_units FROM k GROUP BY 1, 2, 3""")
def rater_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rater_histogram(_valid(spark, sf_dir), "generator")


@query(f"""WITH {_VALID}, w AS (SELECT judge, pass AS own, count(*) OVER u - 1 AS n, sum(pass) OVER u - pass AS p FROM valid WINDOW u AS (PARTITION BY unit)),
c AS (SELECT judge, own, CASE WHEN 2 * p > n THEN 1 WHEN 2 * p < n THEN 0 END AS c FROM w WHERE n >= 2),
f AS (SELECT judge, count(*) FILTER (own = 1 AND c = 1)::DOUBLE AS tp, count(*) FILTER (own = 0 AND c = 0)::DOUBLE AS tn,
    count(*) FILTER (own = 1 AND c = 0)::DOUBLE AS fp, count(*) FILTER (own = 0 AND c = 1)::DOUBLE AS fn, count(*) FILTER (c IS NULL) AS n_ties FROM c GROUP BY 1),
g AS (SELECT *, tp + tn + fp + fn AS n FROM f),
h AS (SELECT *, (tp + tn) / nullif(n, 0) AS a, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / nullif(n * n, 0) AS e FROM g)
SELECT judge, n::BIGINT AS n, n_ties, round(a, 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,
       round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS "precision",
       round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((a - e) / nullif(1 - e, 0), 6) AS kappa FROM h""")
def leave_one_out_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.binary_metrics(R.leave_one_out_verdicts(_valid(spark, sf_dir)), "judge")


@query(f"""WITH {_VALID}, s AS (SELECT unit, judge, score FROM valid WHERE score BETWEEN 1 AND 5),
p AS (SELECT a.judge, a.unit, a.score AS own, quantile_disc(b.score, 0.5) AS con, count(*) AS others
    FROM s a JOIN s b ON a.unit = b.unit AND a.judge <> b.judge GROUP BY 1, 2, 3 HAVING count(*) >= 2),
r AS (SELECT *, rank() OVER (PARTITION BY judge ORDER BY own) + (count(*) OVER (PARTITION BY judge, own) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY judge ORDER BY con) + (count(*) OVER (PARTITION BY judge, con) - 1) / 2.0 AS rb FROM p),
x AS (SELECT a.judge, avg((a.own - b.con) * (a.own - b.con)) AS e FROM (SELECT judge, own FROM p) a JOIN (SELECT judge, con FROM p) b USING (judge) GROUP BY 1)
SELECT judge, count(*) AS n, round(avg((own = con)::INT), 6) AS exact, round(avg(abs(own - con)), 6) AS mae,
       round(avg((own - con) * (own - con)), 6) AS mse, round(corr(ra, rb), 6) AS spearman,
       round(1 - avg((own - con) * (own - con)) / any_value(e), 6) AS weighted_kappa FROM r JOIN x USING (judge) GROUP BY 1""")
def leave_one_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordinal_metrics(R.leave_one_out_scores(_valid(spark, sf_dir)), "judge")


_UNITS = f"""{_VALID}, c AS (SELECT unit, {{value}} AS v, count(*) AS c FROM valid GROUP BY 1, 2), n AS (SELECT *, sum(c) OVER (PARTITION BY unit) AS n FROM c),
parts AS (SELECT a.unit, a.v, a.c, sum(a.c * b.c * {{distance}}) / (a.n - 1.0) AS o FROM n a JOIN n b USING (unit) WHERE a.n > 1 GROUP BY a.unit, a.v, a.c, a.n),
keyed AS (SELECT *, {sql_bits("unit::VARCHAR")} AS k1, {sql_bits("unit::VARCHAR", 9)} AS k2 FROM parts), {sql_replicates(1000)},
m AS (SELECT replicate, v, sum(w * c) AS m, sum(w * o) AS o FROM (SELECT replicate, v, c, o, {SQL_POISSON} AS w FROM (SELECT keyed.*, replicate, {SQL_DRAW} AS z FROM keyed, replicates))
    WHERE w > 0 GROUP BY 1, 2),
t AS (SELECT replicate, sum(m)::DOUBLE AS n, sum(o) AS o FROM m GROUP BY 1),
e AS (SELECT a.replicate, sum(a.m::DOUBLE * b.m * {{distance}}) AS e FROM m a JOIN m b USING (replicate) GROUP BY 1),
r AS (SELECT coalesce(1 - (o / n) / nullif(e / (n * (n - 1)), 0), 1.0) AS alpha FROM t JOIN e USING (replicate))
SELECT round(quantile_cont(alpha, 0.5), 6) AS median, round(quantile_cont(alpha, 0.025), 6) AS low, round(quantile_cont(alpha, 0.975), 6) AS high FROM r"""


@query("WITH " + _UNITS.format(value="pass", distance="(a.v <> b.v)::INT"))
def alpha_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the nominal alpha over resampled units."""
    return B.percentile_interval(B.alpha_bootstrap(_valid(spark, sf_dir), "pass", iterations=1000), "alpha")


@query("WITH " + _UNITS.format(value="score", distance="(a.v - b.v) * (a.v - b.v)"))
def alpha_score_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the interval-scaled alpha over resampled units."""
    return B.percentile_interval(B.alpha_bootstrap(_valid(spark, sf_dir), "score", R.interval, 1000), "alpha")


_AGREED = f"""{_VALID}, w AS (SELECT judge, pass AS own, count(*) OVER u - 1 AS n, sum(pass) OVER u - pass AS p FROM valid WINDOW u AS (PARTITION BY unit)),
k AS (SELECT judge AS key, count(*) FILTER (own = (2 * p > n)::INT) AS c, count(*) AS n FROM w WHERE n >= 2 AND 2 * p <> n GROUP BY 1),
cdf AS (SELECT key, c, n, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p))) OVER (PARTITION BY key ORDER BY x) AS f
    FROM (SELECT *, c / n::DOUBLE AS p, unnest(range(n + 1)) AS x FROM k))"""


def _agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = R.leave_one_out_verdicts(_valid(spark, sf_dir)).where("consensus is not null")
    return pairs.groupBy(F.col("judge").alias("key")).agg(F.count_if(F.col("own") == F.col("consensus")).alias("c"), F.count("*").alias("n"))


@query(f"""WITH {_AGREED}, keyed AS (SELECT key, n, {sql_bits("key::VARCHAR")} AS k1, {sql_bits("key::VARCHAR", 9)} AS k2 FROM k), {sql_replicates(1000)},
u AS (SELECT key, quantile_cont(z / {P}.0, 0.025) AS low, quantile_cont(z / {P}.0, 0.975) AS high FROM (SELECT key, {SQL_DRAW} AS z FROM keyed, replicates) GROUP BY 1)
SELECT key, round(min(x) FILTER (f >= low) / any_value(n)::DOUBLE, 6) AS low, round(min(x) FILTER (f >= high) / any_value(n)::DOUBLE, 6) AS high FROM cdf JOIN u USING (key) GROUP BY 1""")
def agreement_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomially resampled interval of every judge's agreement with the others."""
    ends = B.proportion_bootstrap(_agreed(spark, sf_dir))
    return ends.select("key", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {_AGREED} SELECT key, c, n, round(min(x) FILTER (f >= 0.025) / n::DOUBLE, 6) AS low, round(min(x) FILTER (f >= 0.975) / n::DOUBLE, 6) AS high FROM cdf GROUP BY 1, 2, 3""")
def agreement_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval that the resampled one tends to, from the binomial distribution itself."""
    ends = B.proportion_interval(_agreed(spark, sf_dir))
    return ends.select("key", "c", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
