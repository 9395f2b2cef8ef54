"""Accuracy, misses and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.operators import accuracy as A
from veridict.operators import ingest as I
from veridict.operators import leaderboard as L
from veridict.operators import stats as S
from veridict.operators import validity as V
from veridict.plans import query
from veridict.sources.tables import SQL_ANSWERS, SQL_ATTEMPTS, SQL_RATINGS, answers, attempts, ratings, table

_RUNS = f"""{SQL_RATINGS}, {SQL_ANSWERS}, accepted AS (
    SELECT run_id, unit FROM ratings GROUP BY 1, 2
    HAVING 2 * count(*) FILTER (output_valid AND score >= 2 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 2)),
runs AS (SELECT run_id, generator, model, count(*) FILTER (pred = gold) / count(*)::DOUBLE AS acc, count(*) AS n_items
    FROM answers SEMI JOIN accepted USING (run_id, unit) WHERE pred IS NOT NULL GROUP BY 1, 2, 3)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = V.keep_accepted(answers(spark, sf_dir), ratings(spark, sf_dir), min_score=2)
    return A.run_accuracy(kept)


@query(f"""WITH {_RUNS} SELECT run_id, generator, model, round(acc, 6) AS acc, n_items FROM runs""")
def filtered_run_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("acc", F.round("acc", 6))


_MACRO = "round(avg(acc), 6) AS mean_acc, round(stddev_samp(acc) / sqrt(count(*)), 6) AS sem, count(*) AS n_quizzes"


@query(f"WITH {_RUNS} SELECT generator, model, {_MACRO} FROM runs GROUP BY 1, 2")
def macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over judged-valid questions: mean over quizzes by generator and answering model."""
    return A.macro_accuracy(_runs(spark, sf_dir), "generator", "model")


@query(f"WITH {_RUNS} SELECT model, {_MACRO} FROM runs GROUP BY 1")
def macro_accuracy_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.macro_accuracy(_runs(spark, sf_dir), "model")


@query(f"""WITH {_RUNS} SELECT coalesce(generator, 'ALL') AS generator, coalesce(model, 'ALL') AS model,
       round(avg(acc), 6) AS mean_acc, count(*) AS n_quizzes FROM runs GROUP BY CUBE (generator, model)""")
def accuracy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracy_matrix(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, extra AS (SELECT * FROM (VALUES ('1-URGENT', 'human', 0.75, 10), ('2-HIGH', 'm1', 0.5, 4), ('none', 'm1', 1.0, 4))
    v(generator, model, acc, n_items)), merged AS (SELECT generator, model, acc FROM runs
    UNION ALL SELECT generator, model, acc::DOUBLE FROM extra SEMI JOIN runs USING (generator))
SELECT generator, model, {_MACRO} FROM merged GROUP BY 1, 2""")
def macro_accuracy_with_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("1-URGENT", "human", 0.75, 10), ("2-HIGH", "m1", 0.5, 4), ("none", "m1", 1.0, 4)]
    extra = spark.createDataFrame(rows, "generator string, model string, acc double, n_items long")
    return A.macro_accuracy(A.with_extra_results(_runs(spark, sf_dir), extra), "generator", "model")


@query(f"""WITH {SQL_RATINGS}, {SQL_ANSWERS}
SELECT model, count(*) FILTER (pred = gold) AS total_corr, count(*) FILTER (pred IS NULL OR pred <> gold) AS total_wrong,
       round(count(*) FILTER (pred = gold) / count(*)::DOUBLE, 6) AS acc FROM answers GROUP BY 1""")
def evaluator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evaluator_summary(answers(spark, sf_dir), "model")


@query(f"""WITH {SQL_RATINGS}, {SQL_ANSWERS}
SELECT generator, model, count(*) FILTER (pred IS NULL OR trim(pred) <> trim(gold)) AS n_missed, count(*) AS n_total,
       round(count(*) FILTER (pred IS NULL OR trim(pred) <> trim(gold)) / count(*)::DOUBLE, 6) AS miss_rate FROM answers GROUP BY 1, 2""")
def miss_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.miss_rates(answers(spark, sf_dir), "generator", "model")


_SHARE = """cells AS (SELECT coalesce(quiz, 'ALL') AS "group", topic, count(*) AS n FROM missed GROUP BY GROUPING SETS ((quiz, topic), (topic)))
SELECT "group", topic, n AS n_missed, round(n / sum(n) OVER (PARTITION BY "group"), 6) AS share FROM cells"""


@query(f"WITH {SQL_ATTEMPTS}, missed AS (SELECT * FROM attempts WHERE y = 0), {_SHARE}")
def topic_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topic_misses(attempts(spark, sf_dir))


@query(f"WITH {SQL_ATTEMPTS}, missed AS (SELECT DISTINCT quiz, topic, item FROM attempts WHERE y = 0), {_SHARE}")
def topic_misses_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topic_misses(attempts(spark, sf_dir), unique_questions=True)


@query(f"""WITH {SQL_ATTEMPTS}, cells AS (
    SELECT coalesce(quiz, 'ALL') AS "group", topic, count(*) AS n, count(*) FILTER (y = 0) AS m
    FROM attempts GROUP BY GROUPING SETS ((quiz, topic), (topic))),
full_ AS (SELECT *, sum(n) OVER w AS tn, sum(m) OVER w AS tm FROM cells WINDOW w AS (PARTITION BY "group"))
SELECT "group", topic, n AS n_total, m AS n_missed, round(m / n::DOUBLE, 6) AS miss_rate, round(n / tn, 6) AS prevalence,
       round(m / tm, 6) AS miss_share, round((m / tm) / (n / tn), 6) AS over_under FROM full_ WHERE m > 0""")
def miss_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.enrichment_order(A.miss_enrichment(attempts(spark, sf_dir)))


@query(f"""WITH {SQL_ATTEMPTS}, cells AS (SELECT coalesce(quiz, 'ALL') AS "group", topic, avg(y) AS acc
    FROM attempts GROUP BY GROUPING SETS ((quiz, topic), (topic)))
SELECT DISTINCT "group", first(topic) OVER (PARTITION BY "group" ORDER BY acc, topic) AS hardest,
       round(min(acc) OVER (PARTITION BY "group"), 6) AS lowest,
       first(topic) OVER (PARTITION BY "group" ORDER BY acc DESC, topic) AS easiest,
       round(max(acc) OVER (PARTITION BY "group"), 6) AS highest FROM cells""")
def topic_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topic_extremes(attempts(spark, sf_dir))


@query(f"""WITH {SQL_RATINGS}, {SQL_ANSWERS}, kept AS (
    SELECT c.cutoff, run_id, unit FROM ratings, (VALUES (4), (5)) c(cutoff) GROUP BY 1, 2, 3
    HAVING 2 * count(*) FILTER (output_valid AND score >= 3 AND score >= cutoff) > count(*) FILTER (output_valid AND score >= 3)),
runs AS (SELECT cutoff, model, run_id, count(*) FILTER (pred = gold) AS c, count(*) AS n FROM answers JOIN kept USING (run_id, unit)
    WHERE pred IS NOT NULL GROUP BY 1, 2, 3)
SELECT cutoff, model, round(avg(c / n::DOUBLE), 6) AS mean_acc, round(stddev_samp(c / n::DOUBLE) / sqrt(count(*)), 6) AS sem,
       round(sum(c) / sum(n)::DOUBLE, 6) AS micro_acc, sum(n)::BIGINT AS n_items FROM runs GROUP BY 1, 2""")
def cutoff_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = V.accepted_by_cutoff(ratings(spark, sf_dir), [4, 5])
    return A.cutoff_accuracy(answers(spark, sf_dir), kept)


@query(f"""WITH {SQL_ATTEMPTS}
SELECT llm, count(*) AS n_items, 0::BIGINT AS n_repeats, (SELECT count(DISTINCT item) FROM attempts) - count(*) AS n_missing,
       round(avg(y), 6) AS accuracy FROM attempts GROUP BY 1""")
def pairing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pairing_audit(attempts(spark, sf_dir))


@query(f"""WITH {SQL_ATTEMPTS} SELECT item FROM attempts GROUP BY 1 HAVING count(DISTINCT llm) = (SELECT count(DISTINCT llm) FROM attempts)""")
def complete_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.complete_items(attempts(spark, sf_dir))


@query(f"""WITH {SQL_ATTEMPTS}, items AS (SELECT item, topic, avg(y) AS p FROM attempts GROUP BY 1, 2),
topics AS (SELECT topic, count(*) AS n_items, avg(p) AS p FROM items GROUP BY 1)
SELECT topic, n_items, round(p, 6) AS mean_p, row_number() OVER (ORDER BY p, topic)::INT AS rank FROM topics""")
def topic_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.item_difficulty(attempts(spark, sf_dir))


@query(f"""WITH {SQL_ATTEMPTS}, acc AS (SELECT llm::VARCHAR AS model, avg(y) AS mean_acc FROM attempts GROUP BY 1),
cost AS (SELECT (s_suppkey % 10)::VARCHAR AS model, round(avg(s_acctbal), 2) AS cost FROM supplier GROUP BY 1),
valid AS (SELECT (s_suppkey % 5 + 1)::VARCHAR AS model, round(count(*) FILTER (s_acctbal > 0) / count(*)::DOUBLE, 6) AS validity FROM supplier GROUP BY 1)
SELECT model, round(mean_acc, 6) AS mean_acc, cost, validity, rank, CASE WHEN rank <= 3 THEN rank END AS medal FROM (
    SELECT *, row_number() OVER (ORDER BY mean_acc DESC, lower(model))::INT AS rank
    FROM acc LEFT JOIN cost USING (model) LEFT JOIN valid USING (model))""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = attempts(spark, sf_dir).groupBy(F.col("llm").cast("string").alias("model")).agg(F.avg("y").alias("mean_acc"))
    supplier = table(spark, sf_dir, "supplier")
    cost = supplier.groupBy((F.col("s_suppkey") % 10).cast("string").alias("model")).agg(F.round(F.avg("s_acctbal"), 2).alias("cost"))
    share = F.round(F.count_if(F.col("s_acctbal") > 0) / F.count("*"), 6)
    validity = supplier.groupBy((F.col("s_suppkey") % 5 + 1).cast("string").alias("model")).agg(share.alias("validity"))
    return L.leaderboard(acc, cost, validity).withColumn("mean_acc", F.round("mean_acc", 6))


@query("""WITH m AS (SELECT s_suppkey::VARCHAR AS model, min(s_acctbal) AS cost, avg((l_linestatus = 'F')::INT) AS acc
    FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)
SELECT model, cost, round(acc, 6) AS acc FROM (
    SELECT *, max(acc) OVER (ORDER BY cost, acc DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m)
WHERE best IS NULL OR acc > best + 1e-9""")
def cost_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("acc"))
    rows = supplier.join(line, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("s_suppkey").cast("string").alias("model"), F.col("s_acctbal").alias("cost"), "acc"
    )
    return L.pareto_frontier(rows).withColumn("acc", F.round("acc", 6))


@query(f"""WITH {_RUNS}, q AS (SELECT model, avg(acc) AS m, count(*) AS n FROM runs GROUP BY 1)
SELECT model, n, round(m, 6) AS mean FROM q""")
def quiz_level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of quiz_interval; its t quantile is an approximation and tested by itself."""
    return S.quiz_interval(_runs(spark, sf_dir), "model").select("model", "n", "mean")


_PAIRED = f"""{SQL_ATTEMPTS}, own AS (SELECT item, llm, max(y) AS y FROM attempts WHERE (item + llm) % 9 <> 0 GROUP BY 1, 2)"""


@query(f"""WITH {_PAIRED} SELECT g.item, g.llm, coalesce(y, 0) AS y FROM (SELECT item, llm FROM (SELECT DISTINCT item FROM own) CROSS JOIN (SELECT DISTINCT llm FROM own)) g LEFT JOIN own USING (item, llm)""")
def paired_outcomes_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all items by all llms, where what is missing counts as wrong."""
    return A.paired_outcomes(attempts(spark, sf_dir).where("(item + llm) % 9 <> 0"), missing_as_zero=True)


@query(f"""WITH {_PAIRED} SELECT item, llm, y FROM own WHERE item IN (SELECT item FROM own GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT llm) FROM own))""")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the items that all llms have tried."""
    return A.paired_outcomes(attempts(spark, sf_dir).where("(item + llm) % 9 <> 0"))


@query(f"""WITH {SQL_ATTEMPTS}, s AS (SELECT item, count(y) AS n, round(avg(y), 6) AS p FROM attempts GROUP BY 1)
SELECT item, n, p, p_type AS topic, p_brand AS quiz FROM s LEFT JOIN part ON p_partkey = item AND p_size > 10""")
def described_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of right answers of all items, with topic and quiz where these are known."""
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("topic"), F.col("p_brand").alias("quiz"))
    return A.described_items(attempts(spark, sf_dir), known)


_SETS = """q AS (SELECT p_partkey AS question_id, p_type AS category FROM part WHERE p_partkey % 6 <> 0)"""


@query(f"""WITH {_SETS} SELECT category, row_number() OVER (PARTITION BY category ORDER BY question_id)::INT AS place, question_id, count(*) OVER (PARTITION BY category) AS n_category,
    CASE WHEN question_id % 5 = 0 THEN 1 ELSE 2 END AS n_options FROM q QUALIFY place <= 5""")
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five questions of every category, whose options come as text that is nearly JSON; some can't be read."""
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, "[broken").when(k % 5 == 0, F.concat(F.lit("[“N/A”, “"), F.col("p_name"), F.lit("”]"))).otherwise(F.concat(F.lit('["x", "'), F.col("p_name"), F.lit('"]')))
    rows = table(spark, sf_dir, "part").select(k.alias("question_id"), F.col("p_type").alias("category"), text.alias("options"))
    found = I.head(I.question_sets(rows), 5)
    return found.select("category", "place", "question_id", "n_category", F.size("options").alias("n_options"))
