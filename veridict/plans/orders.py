"""Orders of report tables, seen as places, and the bookkeeping of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.operators import accuracy as A
from veridict.operators import leaderboard as L
from veridict.operators import topics as T
from veridict.operators import validity as V
from veridict.plans import query
from veridict.plans.parity import values
from veridict.sources.tables import SQL_ANSWERS, SQL_ATTEMPTS, SQL_LINES, SQL_RATINGS, answers, attempts, ratings, table

_MISSES = f"""{SQL_LINES}, {SQL_ANSWERS}, m AS (SELECT model, count(*) FILTER (trim(pred) = trim(gold) IS NOT TRUE) AS n_missed, count(*) AS n_total FROM answers GROUP BY 1)"""


@query(f"WITH {_MISSES} SELECT model, n_missed, row_number() OVER (ORDER BY round(n_missed / n_total::DOUBLE, 6) DESC, n_missed DESC, model)::INT AS place FROM m")
def misses_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by falling miss rate, misses, name."""
    rates = A.miss_rates(answers(spark, sf_dir), "model")
    return L.placed(rates, F.desc("miss_rate"), F.desc("n_missed"), "model").select("model", "n_missed", "place")


@query(f"""WITH {SQL_ATTEMPTS}, c AS (SELECT CASE WHEN grouping(quiz) = 1 THEN 'ALL' ELSE quiz END AS g, topic, count(*) AS n, count(*) FILTER (y = 0) AS m
    FROM attempts GROUP BY GROUPING SETS ((quiz, topic), (topic))), t AS (SELECT *, sum(n) OVER (PARTITION BY g) AS tn, sum(m) OVER (PARTITION BY g) AS tm FROM c),
e AS (SELECT g, topic, m, round(m / n::DOUBLE, 6) AS rate, round((m / tm::DOUBLE) / (n / tn::DOUBLE), 6) AS ratio FROM t WHERE m > 0)
SELECT g AS "group", topic, row_number() OVER (ORDER BY g <> 'ALL', g, ratio DESC, rate DESC, m DESC, topic)::INT AS place FROM e""")
def enrichment_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALL first, then quizzes; within them by over/under ratio, rate, misses, topic."""
    rows = A.enrichment_order(A.miss_enrichment(attempts(spark, sf_dir)))
    ratio = F.when(F.col("over_under") == 0, None).otherwise(F.col("over_under"))
    order = [F.when(F.col("group") == "ALL", 0).otherwise(1), "group", F.desc_nulls_last(ratio), F.desc_nulls_last("miss_rate"), F.desc("n_missed"), "topic"]
    return L.placed(rows, *order).select("group", "topic", "place")


@query("""SELECT generator, topic, n, place::INT AS place FROM (SELECT p_brand AS generator, p_type AS topic, count(*) AS n,
       row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1, 2) WHERE place <= 3""")
def most_common_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent topics of every generator."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("generator"), F.col("p_type").alias("topic")).agg(F.count("*").alias("n"))
    return L.placed(counts, F.desc("n"), "topic", by=("generator",), most=3)


@query(f"WITH {_MISSES} SELECT model, (row_number() OVER (ORDER BY round(1 - n_missed / n_total::DOUBLE, 6) DESC, model))::INT AS place FROM m QUALIFY place <= 2")
def most_accurate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = A.miss_rates(answers(spark, sf_dir), "model").withColumn("acc", F.round(1 - F.col("n_missed") / F.col("n_total"), 6))
    return L.placed(rates, F.desc("acc"), "model", most=2).select("model", "place")


@query(f"""WITH {SQL_ATTEMPTS}, s AS (SELECT llm, avg(y) AS v FROM attempts GROUP BY 1),
p AS (SELECT a.llm AS a, b.llm AS b, round(a.v - b.v, 6) AS d FROM s a JOIN s b ON a.llm < b.llm)
SELECT a, b, d, row_number() OVER (ORDER BY abs(d) DESC, a, b)::INT AS place FROM p""")
def pairs_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of models by the size of their difference."""
    scores = attempts(spark, sf_dir).groupBy("llm").agg(F.avg("y").alias("v")).agg(F.sort_array(F.collect_list(F.struct("llm", "v"))).alias("m"))
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.llm as a, y.llm as b, round(x.v - y.v, 6) as d))))")
    long = scores.select(F.explode(pairs).alias("e")).select("e.*")
    return L.placed(long, F.desc(F.abs("d")), "a", "b")


@query(f"""WITH {SQL_RATINGS}, accepted AS (SELECT run_id, unit FROM ratings GROUP BY 1, 2
    HAVING 2 * count(*) FILTER (output_valid AND score >= 2 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 2)),
r AS (SELECT generator, round(count(a.unit) / count(*)::DOUBLE, 6) AS rate FROM (SELECT DISTINCT run_id, unit, generator FROM ratings) u
    LEFT JOIN accepted a USING (run_id, unit) GROUP BY 1) SELECT generator, row_number() OVER (ORDER BY rate DESC, generator)::INT AS place FROM r""")
def generators_by_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    rates = V.validity_by_generator(r.select("run_id", "unit", "generator").distinct(), V.accepted_units(r, min_score=2))
    return L.placed(rates.where("generator <> 'TOTAL'"), F.desc("rate"), "generator").select("generator", "place")


_MODEL = "CASE p_partkey % 4 WHEN 0 THEN 'claude-' WHEN 1 THEN 'gpt-' WHEN 2 THEN 'my-claude-' ELSE 'claude' END || p_size"


@query(f"SELECT p_partkey AS k, {_MODEL} AS model, CASE WHEN p_partkey % 4 = 0 THEN 'anthropic' ELSE 'openai' END AS batch, 'sequential' AS single FROM part")
def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transports of models that are named after parts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_MODEL).alias("model"))
    return rows.select("k", "model", L.provider(F.col("model"), True).alias("batch"), L.provider(F.col("model"), False).alias("single"))


@query("""WITH c AS (SELECT p_type AS category, count(*) FILTER (p_size > 25) AS need, count(*) FILTER (p_retailprice > 1200) AS valid FROM part GROUP BY 1)
SELECT category, ceil(need * 1.5)::BIGINT AS ask, least(valid, need) AS advance, need - least(valid, need) AS "left" FROM c""")
def next_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions to ask for by type, where large parts are needed and dear ones are valid."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"))
    return L.next_request(counts.agg(F.count_if(F.col("p_size") > 25).alias("need"), F.count_if(F.col("p_retailprice") > 1200).alias("valid")))


@query("""WITH p AS (SELECT p_type AS category, count(*) AS planned FROM part WHERE p_partkey % 5 > 0 AND p_type <> 'PROMO' GROUP BY 1),
c AS (SELECT p_type AS category, count(*) AS n FROM part WHERE p_partkey % 5 > 0 OR p_type LIKE '%A%' GROUP BY 1)
SELECT category, coalesce(planned, 0) AS planned, coalesce(n, 0) AS asked FROM p FULL JOIN c USING (category) WHERE coalesce(planned, 0) <> coalesce(n, 0)""")
def plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of which a plan holds another number of parts than was asked for."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_type", "category")
    asked = parts.where("p_partkey % 5 > 0 or category like '%A%'").groupBy("category").agg(F.count("*").alias("n"))
    return L.plan_errors(parts.where("p_partkey % 5 > 0 and category <> 'PROMO'").select("category"), asked)


#: (topic, mapped topic, response, topic after): every part is one of these, and its response ends in its size.
_LABELS = [
    ("Hematology/Oncology", "Misc", "Hematology.", "Hematology"), ("Hematology & oncology", "Misc", "both hematology and oncology", "Misc"),
    ("Oncology", "Medical Oncology", "Hematology", "Medical Oncology"), ("Hematology and Oncology", "Medical Oncology", "oncology", "Medical Oncology"),
    ("hematology / ONCOLOGY", "Hematology", "I think medical oncology:", "Medical Oncology"), ("Cardiology", "Cardiology", "hematology", "Cardiology"),
    ("Hematology/Oncology", "Hematology", None, "Hematology"),
]


@query(f"""SELECT p_partkey AS question_id, topic, after AS mapped, CASE WHEN after <> mapped THEN mapped END AS mapped_before FROM part
JOIN {values([(k, a, b, d) for k, (a, b, _, d) in enumerate(_LABELS)], 'k, topic, mapped, after')} ON p_partkey % {len(_LABELS)} = k""")
def refined_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts that name two topics, told apart by responses; some have none."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), "p_size")
    choice = lambda place: F.element_at(F.array(*(F.lit(row[place]) for row in _LABELS)), (F.col("question_id") % len(_LABELS) + 1).cast("int"))
    responses = part.select("question_id", F.concat(choice(2), F.lit("\n"), F.col("p_size").cast("string")).alias("response"))
    return T.refined(part.select("question_id", choice(0).alias("topic"), choice(1).alias("mapped")), responses.where("response is not null"))
