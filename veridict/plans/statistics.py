"""Tests and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.functions.random import SQL_DRAW, SQL_POISSON, sql_bits, sql_replicates
from veridict.functions.special import sql_chi_square_p
from veridict.operators import resample as B
from veridict.operators import stats as S
from veridict.operators import validity as V
from veridict.plans import query
from veridict.sources.tables import SQL_ATTEMPTS, SQL_RATINGS, attempts, ratings

_Z = S.Z


@query(f"""WITH {SQL_ATTEMPTS}, c AS (SELECT topic, llm, sum(y) AS c, count(*)::DOUBLE AS n FROM attempts GROUP BY 1, 2),
w AS (SELECT *, c / n AS p, {_Z}::DOUBLE AS z FROM c)
SELECT topic, llm, n::BIGINT AS n, round(p, 6) AS acc,
       round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
       round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM w""")
def wilson_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.proportions(attempts(spark, sf_dir), "y", "topic", "llm")


@query(f"""WITH o AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2),
r AS (SELECT p_type, sum(n) AS r FROM o GROUP BY 1), k AS (SELECT p_brand, sum(n) AS k FROM o GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM o),
c AS (SELECT f.p_type, f.p_brand, coalesce(n, 0) AS n, r * k / t AS e
    FROM (SELECT * FROM r CROSS JOIN k CROSS JOIN t) f LEFT JOIN o ON o.p_type = f.p_type AND o.p_brand = f.p_brand),
d AS (SELECT count(DISTINCT p_type) AS a, count(DISTINCT p_brand) AS b FROM o),
s AS (SELECT sum((n - e) * (n - e) / e) AS chi2, any_value((a - 1) * (b - 1))::BIGINT AS dof, any_value(t) * (least(any_value(a), any_value(b)) - 1) AS m, min(e) AS least FROM c, d, t)
SELECT round(chi2, 6) AS chi2, dof, round({sql_chi_square_p('chi2', 'dof')}, 6) AS p, round(sqrt(chi2 / m), 6) AS cramers_v, round(least, 6) AS min_expected FROM s""")
def topic_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return S.chi_square(part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n")), "p_type", "p_brand")


@query(f"""WITH {SQL_ATTEMPTS}, i AS (SELECT item, topic, avg(y) AS p FROM attempts GROUP BY 1, 2),
g AS (SELECT topic, count(*) AS n, avg(p) AS m FROM i GROUP BY 1), a AS (SELECT avg(p) AS m, count(*) AS n FROM i),
b AS (SELECT sum(g.n * (g.m - a.m) * (g.m - a.m)) AS between_, count(*) AS k FROM g, a),
w AS (SELECT sum((p - m) * (p - m)) AS within_ FROM i JOIN g USING (topic))
SELECT round((between_ / (k - 1)) / (within_ / (n - k)), 6) AS f, round(between_ / (between_ + within_), 6) AS eta2, k, n FROM a, b, w""")
def topic_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = attempts(spark, sf_dir).groupBy("item", "topic").agg(F.avg("y").alias("p"))
    return S.anova(items, "p", "topic")


_COUNTS = f"""{SQL_RATINGS}, accepted AS (SELECT run_id, unit FROM ratings GROUP BY 1, 2
    HAVING 2 * count(*) FILTER (output_valid AND score >= 2 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 2)),
counts AS (SELECT generator, count(*)::DOUBLE AS n, count(a.unit)::DOUBLE AS x FROM (SELECT DISTINCT run_id, unit, generator FROM ratings)
    LEFT JOIN accepted a USING (run_id, unit) GROUP BY 1)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    units = r.select("run_id", "unit", "generator").distinct()
    return V.validity_by_generator(units, V.accepted_units(r, min_score=2)).where("generator <> 'TOTAL'")


@query(f"""WITH {_COUNTS}, p AS (SELECT sum(x) / sum(n) AS p FROM counts),
g AS (SELECT 2 * sum(CASE WHEN x > 0 THEN x * ln(x / (n * p)) ELSE 0 END + CASE WHEN n > x THEN (n - x) * ln((n - x) / (n * (1 - p))) ELSE 0 END) AS g2, count(*) - 1 AS dof FROM counts, p)
SELECT round(g2, 6) AS g2, dof, round({sql_chi_square_p('g2', 'dof')}, 6) AS p FROM g""")
def validity_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deviance(_counts(spark, sf_dir))


@query(f"""WITH {_COUNTS}, pairs AS (SELECT a.generator AS a, b.generator AS b, a.x AS xa, a.n AS na, b.x AS xb, b.n AS nb,
    (a.x + b.x) / (a.n + b.n) AS p, abs(a.x / a.n - b.x / b.n) AS gap, 1 / a.n + 1 / b.n AS h FROM counts a JOIN counts b ON a.generator < b.generator),
t AS (SELECT a, b, power(gap - least(0.5, gap / h) * h, 2) / (p * (1 - p) * h) AS chi2 FROM pairs),
s AS (SELECT *, sqrt(chi2 / 2) AS z, 1 / (1 + 0.3275911 * sqrt(chi2 / 2)) AS t FROM t),
e AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z) AS p FROM s),
q AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS raw FROM e)
SELECT a, b, round(chi2, 6) AS chi2, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM q""")
def validity_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairwise_proportions(_counts(spark, sf_dir), "generator")


_ITEMS = f"{SQL_ATTEMPTS}, i AS (SELECT item, topic, quiz AS stratum, avg(y) AS value FROM attempts GROUP BY 1, 2, 3)"


def _drawn(source: str, key: str, iterations: int = 500) -> str:
    """Common table expressions up to ``z``: every row of ``source`` in every replicate, with its draw."""
    return f"""keyed AS (SELECT *, {sql_bits(key)} AS k1, {sql_bits(key, 9)} AS k2 FROM {source}), {sql_replicates(iterations)},
z AS (SELECT keyed.*, replicate, {SQL_DRAW} AS z FROM keyed, replicates)"""


@query(f"""WITH {SQL_ATTEMPTS}, a AS (SELECT item, llm, max(y) AS y FROM attempts GROUP BY 1, 2),
f AS (SELECT item FROM a GROUP BY 1 HAVING count(y) = (SELECT count(DISTINCT llm) FROM attempts)), {_drawn("f", "item::VARCHAR")},
m AS (SELECT replicate, llm, sum(w * y) / sum(w)::DOUBLE AS mean FROM (SELECT replicate, item, {SQL_POISSON} AS w FROM z) JOIN a USING (item) GROUP BY 1, 2 HAVING sum(w) > 0),
d AS (SELECT x.llm AS a, y.llm AS b, x.mean - y.mean AS d FROM m x JOIN m y ON x.replicate = y.replicate AND x.llm < y.llm),
q AS (SELECT a, b, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM d GROUP BY 1, 2)
SELECT *, low > -0.02 AND high < 0.02 AS within_delta FROM q""")
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of the differences between llms."""
    return B.pairwise_differences(B.paired_bootstrap(attempts(spark, sf_dir), 500))


@query(f"""WITH {SQL_ATTEMPTS}, a AS (SELECT item, llm, max(y) AS y FROM attempts GROUP BY 1, 2),
f AS (SELECT item FROM a GROUP BY 1 HAVING count(y) = (SELECT count(DISTINCT llm) FROM attempts)), {_drawn("f", "item::VARCHAR")},
m AS (SELECT replicate, llm, sum(w * y) / sum(w)::DOUBLE AS mean FROM (SELECT replicate, item, {SQL_POISSON} AS w FROM z) JOIN a USING (item) GROUP BY 1, 2 HAVING sum(w) > 0)
SELECT llm, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY 1""")
def paired_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of every llm's accuracy on the items that all have tried."""
    return B.percentile_interval(B.paired_bootstrap(attempts(spark, sf_dir), 500), "mean", "llm")


@query(f"""WITH {_ITEMS}, cells AS (SELECT stratum, topic, count(*) AS c FROM i GROUP BY 1, 2),
ends AS (SELECT stratum, topic, c, sum(c) OVER (PARTITION BY stratum ORDER BY topic) AS hi FROM cells), {_drawn("i", "item::VARCHAR")},
r AS (SELECT replicate, stratum, value, row_number() OVER (PARTITION BY replicate, stratum ORDER BY z, item) AS place FROM z),
d AS (SELECT replicate, topic, sum(value) AS total FROM r JOIN ends e ON e.stratum = r.stratum AND place > hi - c AND place <= hi GROUP BY 1, 2),
s AS (SELECT topic, count(*) AS size, sum(value) AS t, sum(value * value) AS q FROM i GROUP BY 1),
v AS (SELECT sum(total * total / size) AS v FROM d JOIN s USING (topic) GROUP BY replicate),
w AS (SELECT count(*) AS k, sum(size) AS n, sum(t) AS grand, sum(q) AS squares, sum(t * t / size) AS least FROM s)
SELECT round(((least - grand * grand / n) / (k - 1)) / ((squares - least) / (n - k)), 6) AS f,
       round((1 + (SELECT count(*) FROM v WHERE v >= w.least - 1e-9 * greatest(1, abs(w.least)))) / 501.0, 6) AS p_perm FROM w""")
def topic_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F of topics and its permutation p within quizzes."""
    items = attempts(spark, sf_dir).groupBy("item", "topic", F.col("quiz").alias("stratum")).agg(F.avg("y").alias("value"))
    return B.topic_permutation(items, 500)


@query(f"""WITH {_ITEMS}, t AS (SELECT topic, count(*) AS n_items, avg(value) AS mean FROM i GROUP BY 1), {_drawn("i", "topic || '|' || item")},
m AS (SELECT topic, replicate, sum(w * value) / nullif(sum(w), 0) AS d FROM (SELECT topic, replicate, value, {SQL_POISSON} AS w FROM z) GROUP BY 1, 2),
o AS (SELECT topic, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM m GROUP BY 1),
s AS (SELECT quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM (SELECT max(d) - min(d) AS d FROM m GROUP BY replicate))
SELECT topic, n_items, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM t JOIN o USING (topic)
UNION ALL SELECT 'RANGE', (SELECT count(*) FROM t), (SELECT round(max(mean) - min(mean), 6) FROM t), round(low, 6), round(high, 6) FROM s""")
def topic_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by topic with resampled intervals, and the range between topics with its own."""
    items = attempts(spark, sf_dir).groupBy("item", "topic").agg(F.avg("y").alias("value"))
    return B.topic_bootstrap(items, 500)
