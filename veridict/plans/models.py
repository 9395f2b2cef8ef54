"""Models with random effects over the outcomes of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.operators import models as M
from veridict.operators.stats import Z
from veridict.plans import query
from veridict.sources.tables import SQL_ATTEMPTS, attempts


def _sql_moments(rows: str) -> str:
    """DuckDB counterpart of a posterior's moments, node by node."""
    t = "(centre + sqrt(2 / precision) * nodes[i])"
    fit = f"k * ({t} - centre) - n * (ln(1 + exp({t})) - ln(1 + exp(centre)))"
    offset = f"(({t} - a - b) * ({t} - a - b) - (centre - a - b) * (centre - a - b)) / (2 * s * s)"
    weight = f"weights[i] * exp(nodes[i] * nodes[i]) * exp({fit} - {offset})"
    total = lambda v: f"list_sum(list_transform(range(1, {len(M.NODES) + 1}), lambda i: {weight} * {v}))"
    placed = f"SELECT *, w0 + 1 / (s * s) AS precision, (w0 * t0 + (a + b) / (s * s)) / (w0 + 1 / (s * s)) AS centre FROM {rows}, quadrature"
    return f"""SELECT llm, topic, k, n, t0, w0, a, b, s, {total(t)} / {total("1")} AS m, {total(f"{t} * {t}")} / {total("1")} AS q, {total(f"1 / (1 + exp(-{t}))")} / {total("1")} AS p
    FROM ({placed})"""


def _sql_pooling() -> str:
    steps = [f"quadrature AS (SELECT {list(M.NODES)}::DOUBLE[] AS nodes, {list(M.WEIGHTS)}::DOUBLE[] AS weights)"]
    steps.append("c AS (SELECT llm, topic, sum(y)::DOUBLE AS k, count(y)::DOUBLE AS n FROM attempts GROUP BY 1, 2)")
    steps.append("t AS (SELECT *, ln((k + 0.5) / (n - k + 0.5)) AS t0, n * ((k + 0.5) / (n + 1)) * ((n - k + 0.5) / (n + 1)) AS w0 FROM c)")
    steps.append("r0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS a, avg(t0) OVER (PARTITION BY topic) AS b, 1.0::DOUBLE AS s FROM t)")
    for i in range(M.ROUNDS):
        steps.append(f"m{i} AS MATERIALIZED ({_sql_moments(f'r{i}')})")
        steps.append(f"b{i} AS MATERIALIZED (SELECT * REPLACE (avg(m - a) OVER (PARTITION BY topic) AS b) FROM m{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT * REPLACE (avg(m - b) OVER (PARTITION BY llm) AS a) FROM b{i})")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT llm, topic, k, n, t0, w0, a, b, sqrt(avg(q - 2 * m * (a + b) + (a + b) * (a + b)) OVER ()) AS s FROM a{i})")
    return f"""WITH {SQL_ATTEMPTS}, {', '.join(steps)}, f AS ({_sql_moments(f'r{M.ROUNDS}')})
SELECT llm, topic, n::BIGINT AS n, round(k / n, 6) AS raw, round(p, 6) AS pooled, round(1 / (1 + exp(-(m - {Z} * sqrt(q - m * m)))), 6) AS low,
       round(1 / (1 + exp(-(m + {Z} * sqrt(q - m * m)))), 6) AS high, round(p - k / n, 6) AS shrinkage FROM f"""


@query(_sql_pooling())
def pooled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies by llm and topic, partially pooled."""
    cells = attempts(spark, sf_dir).groupBy("llm", "topic").agg(F.sum("y").alias("k"), F.count("y").alias("n"))
    found = M.partial_pooling(cells)
    return found.select("llm", "topic", "n", *(F.round(c, 6).alias(c) for c in ("raw", "pooled", "low", "high", "shrinkage")))


@query()
def mixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Llms compared by a mixed logistic regression: means, and every two of them (tested against direct integration)."""
    model = M.mixed_logistic(attempts(spark, sf_dir))
    means = [("mean", str(v), None, *map(float, (e, s, p)), None, None) for v, e, s, p, _, _ in model.means()]
    pairs = [("pair", str(a), str(b), *map(float, (d, s, change, p, adjusted))) for a, b, d, s, _, change, p, adjusted in model.pairs()]
    test = [("test", "llm", None, model.chi2, None, model.log_likelihood, model.p, None), ("sd", "quiz", None, model.quiz_sd, None, None, None, None), ("sd", "item", None, model.item_sd, None, None, None, None)]
    return spark.createDataFrame(means + pairs + test, "part string, a string, b string, value double, error double, probability double, p double, p_adjusted double")
