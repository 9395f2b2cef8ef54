"""Judge filters and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.operators import validity as V
from veridict.plans import query
from veridict.sources.tables import SQL_RATINGS, ratings, table

_OK = "(output_valid AND score >= {})"


def _units(r: DataFrame) -> DataFrame:
    return r.select("run_id", "unit", "generator").distinct()


_ACCEPTED = f"""accepted AS (
    SELECT run_id, unit FROM ratings GROUP BY 1, 2
    HAVING 2 * count(*) FILTER ({_OK.format(2)} AND verdict = 'PASS') > count(*) FILTER ({_OK.format(2)}))"""
_BY_GENERATOR = """SELECT coalesce(generator, 'TOTAL') AS generator, count(*) AS n_total, count(a.unit) AS n_valid,
       round(count(a.unit) / count(*)::DOUBLE, 6) AS rate
FROM (SELECT DISTINCT run_id, unit, generator FROM ratings) u LEFT JOIN accepted a USING (run_id, unit)
GROUP BY ROLLUP (generator)"""


@query(f"WITH {SQL_RATINGS}, {_ACCEPTED} {_BY_GENERATOR}")
def validity_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    return V.validity_by_generator(_units(r), V.accepted_units(r, min_score=2))


def _all_judges(score_only: bool) -> str:
    ok = _OK.format(2) + ("" if score_only else " AND verdict = 'PASS'")
    return f"""WITH {SQL_RATINGS}, two AS (SELECT * FROM ratings WHERE judge IN (1, 2)), accepted AS (
    SELECT run_id, unit FROM two JOIN (SELECT run_id, count(DISTINCT judge) AS present FROM two GROUP BY 1) USING (run_id)
    GROUP BY 1, 2, present HAVING count(DISTINCT judge) FILTER ({ok}) = present) {_BY_GENERATOR}"""


@query(_all_judges(False))
def validity_all_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    return V.validity_by_generator(_units(r), V.accepted_units(r, judges=[1, 2], min_score=2, mode="all"))


@query(_all_judges(True))
def validity_score_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    return V.validity_by_generator(_units(r), V.accepted_units(r, judges=[1, 2], min_score=2, mode="score"))


def _cutoffs(first: bool) -> str:
    if first:
        kept = """SELECT c.cutoff, run_id, unit, generator FROM ratings, (VALUES (4), (5)) c(cutoff)
        GROUP BY 1, 2, 3, 4 HAVING 2 * count(*) FILTER (output_valid AND score >= 3 AND score >= cutoff) > count(*) FILTER (output_valid AND score >= 3)
        AND 2 * count(*) FILTER (output_valid AND score >= 3 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 3)"""
    else:
        kept = """SELECT c.cutoff, run_id, unit, generator FROM ratings, (VALUES (4), (5)) c(cutoff) GROUP BY 1, 2, 3, 4
        HAVING 2 * count(*) FILTER (output_valid AND score >= cutoff AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= cutoff)"""
    return f"WITH {SQL_RATINGS}, kept AS ({kept}) SELECT generator, cutoff, count(*) AS n_kept FROM kept GROUP BY 1, 2"


@query(_cutoffs(True))
def kept_by_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kept_by_cutoff(ratings(spark, sf_dir), [4, 5])


@query(_cutoffs(False))
def kept_by_cutoff_refiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kept_by_cutoff(ratings(spark, sf_dir), [4, 5], verdicts_first=False)


@query(f"""WITH {SQL_RATINGS}, kept AS (
    SELECT c.cutoff, run_id, unit, generator FROM ratings, (VALUES (4), (5)) c(cutoff) GROUP BY 1, 2, 3, 4
    HAVING 2 * count(*) FILTER (output_valid AND score >= 3 AND score >= cutoff) > count(*) FILTER (output_valid AND score >= 3)
       AND 2 * count(*) FILTER (output_valid AND score >= 3 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 3))
SELECT t.generator, t.n_total, count(k.unit) FILTER (k.cutoff = 4) AS kept_4, count(k.unit) FILTER (k.cutoff = 5) AS kept_5
FROM (SELECT generator, count(DISTINCT unit) AS n_total FROM ratings GROUP BY 1) t LEFT JOIN kept k USING (generator) GROUP BY 1, 2""")
def availability_by_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    totals = _units(r).groupBy("generator").agg(F.count("*").alias("n_total"))
    return V.availability(V.kept_by_cutoff(r, [4, 5]), totals, [4, 5])


@query(f"""WITH {SQL_RATINGS}, gate AS (
    SELECT run_id, unit FROM ratings WHERE output_valid GROUP BY 1, 2
    HAVING count(*) FILTER (verdict = 'PASS') >= 2 AND count(*) >= 3)
SELECT generator, judge, count(*) AS n, sum(score)::BIGINT AS score_sum FROM ratings SEMI JOIN gate USING (run_id, unit)
WHERE output_valid AND score BETWEEN 1 AND 5 GROUP BY 1, 2""")
def scores_gated_by_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = V.votes_to_score(ratings(spark, sf_dir), 2, 3)
    return gated.groupBy("generator", "judge").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("score_sum"))


@query(f"""WITH {SQL_RATINGS}, judges AS (SELECT unnest(range(1, 8))::INT AS judge), seen AS (
    SELECT judge, CASE WHEN NOT output_valid THEN 'invalid_output' ELSE 'verdict' END AS status, run_id, unit
    FROM ratings SEMI JOIN judges USING (judge)),
missing AS (SELECT j.judge, 'missing_row' AS status,
    (SELECT count(*) FROM (SELECT DISTINCT run_id, unit FROM ratings)) - (SELECT count(DISTINCT (run_id, unit)) FROM seen s WHERE s.judge = j.judge) AS n
    FROM judges j)
SELECT judge, status, count(*) AS n FROM seen GROUP BY 1, 2 UNION ALL SELECT * FROM missing WHERE n > 0""")
def judge_output_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    judges = spark.range(1, 8).select(F.col("id").cast("int").alias("judge"))
    return V.judge_status(ratings(spark, sf_dir), judges)


@query(f"""WITH {SQL_RATINGS}, s AS (SELECT * FROM ratings WHERE output_valid AND score BETWEEN 1 AND 5)
SELECT coalesce(generator, 'ALL') AS generator, coalesce(judge, -1) AS judge, round(avg(score), 6) AS mean_score,
       count(*) AS n, count(DISTINCT run_id) AS n_quizzes FROM s GROUP BY CUBE (generator, judge)""")
def medical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.score_table(ratings(spark, sf_dir))


_SUMMARY = f"""{SQL_RATINGS}, summary AS (
    SELECT run_id, generator, judge, count(*) AS n_items, count(*) FILTER (output_valid) AS n_valid_responses,
           count(*) FILTER (output_valid AND verdict = 'PASS') AS n_pass,
           avg(score) FILTER (output_valid) AS medical_score_mean FROM ratings GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SUMMARY}
SELECT generator, judge, sum(n_items)::BIGINT AS n_items, sum(n_valid_responses)::BIGINT AS n_valid, sum(n_pass)::BIGINT AS n_pass,
       round(coalesce(sum(n_pass) / nullif(sum(n_valid_responses), 0)::DOUBLE, 0), 6) AS pass_rate,
       round(sum(medical_score_mean * n_valid_responses) / nullif(sum(n_valid_responses), 0), 6) AS score_mean
FROM summary GROUP BY 1, 2""")
def judge_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary_rollup(V.run_summaries(ratings(spark, sf_dir)))


@query(f"""WITH {_SUMMARY}, rate AS (SELECT *, n_pass / n_valid_responses::DOUBLE AS r FROM summary WHERE n_valid_responses > 0)
SELECT generator, round(avg(r), 6) AS pass_mean, round(stddev_samp(r), 6) AS pass_std, round(avg(medical_score_mean), 6) AS score_mean,
       round(stddev_samp(medical_score_mean), 6) AS score_std, count(medical_score_mean) AS n_judge_evals,
       count(DISTINCT run_id) AS n_quizzes FROM rate GROUP BY 1""")
def ensemble_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ensemble(V.run_summaries(ratings(spark, sf_dir)))


_TAGGED = "SELECT DISTINCT run_id FROM ratings WHERE run_id LIKE '%1'"


@query(f"""WITH {SQL_RATINGS}, {_ACCEPTED}, tagged AS ({_TAGGED}), u AS (SELECT DISTINCT run_id, unit, generator FROM ratings),
s AS (SELECT 'all' AS scope, * FROM u UNION ALL SELECT CASE WHEN run_id IN (FROM tagged) THEN 'tagged' ELSE 'legacy' END, * FROM u)
SELECT scope, CASE WHEN grouping(generator) = 1 THEN 'TOTAL' ELSE generator END AS generator, count(*) AS n_total, count(a.unit) AS n_valid,
       round(count(a.unit) / count(*)::DOUBLE, 6) AS rate FROM s LEFT JOIN accepted a USING (run_id, unit)
GROUP BY GROUPING SETS ((scope, generator), (scope))""")
def validity_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    tagged = r.where("run_id LIKE '%1'").select("run_id")
    return V.validity_by_scope(_units(r), V.accepted_units(r, min_score=2), tagged)


@query(f"""WITH {SQL_RATINGS} SELECT generator, count(DISTINCT (run_id, unit)) AS n_total FROM ratings GROUP BY 1 HAVING count(DISTINCT (run_id, unit)) <> 100""")
def unexpected_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    return V.unexpected_totals(V.validity_by_generator(_units(r), V.accepted_units(r)), 100)


@query(f"""WITH {SQL_RATINGS}, v AS (
    SELECT count(*) FILTER (output_valid AND score >= 2 AND verdict = 'PASS') AS passed, count(*) FILTER (output_valid AND score >= 2) AS eligible
    FROM ratings GROUP BY run_id, unit) SELECT passed, eligible, count(*) AS n_questions FROM v GROUP BY 1, 2""")
def vote_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vote_patterns(ratings(spark, sf_dir), 2)


@query(f"""WITH {SQL_RATINGS} SELECT generator, CASE WHEN output_valid IS NOT TRUE THEN 'invalid_output' WHEN score >= 2 IS NOT TRUE THEN 'low_score'
    WHEN verdict = 'PASS' THEN 'passed' ELSE 'failed' END AS status, count(*) AS n_votes FROM ratings GROUP BY 1, 2""")
def vote_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vote_status(ratings(spark, sf_dir), 2)


_SELECTED = "selected AS (SELECT DISTINCT run_id, unit, generator FROM ratings WHERE unit % 2 = 0)"


def _selected(r: DataFrame) -> DataFrame:
    return _units(r).where("unit % 2 = 0")


@query(f"""WITH {SQL_RATINGS}, {_SELECTED}, grid AS (SELECT *, unnest([1, 2, 9]) AS judge FROM selected)
SELECT judge, count(*) AS n, count(r.unit) AS n_rows, count(score) AS n_scored FROM grid g
LEFT JOIN ratings r ON r.run_id = g.run_id AND r.unit = g.unit AND r.judge = g.judge GROUP BY 1""".replace("SELECT judge, count", "SELECT g.judge, count"))
def rows_by_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    rows = V.rows_by_judge(_selected(r), [1, 2, 9], r)
    return rows.groupBy("judge").agg(F.count("*").alias("n"), F.count_if("has_judge_row").alias("n_rows"), F.count("score").alias("n_scored"))


@query(f"""WITH {SQL_RATINGS}, {_SELECTED}, kept AS (
    SELECT c.cutoff, run_id, unit FROM ratings, (VALUES (4), (5)) c(cutoff) GROUP BY 1, 2, 3
    HAVING 2 * count(*) FILTER (output_valid AND score >= 3 AND score >= cutoff) > count(*) FILTER (output_valid AND score >= 3)
       AND 2 * count(*) FILTER (output_valid AND score >= 3 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 3))
SELECT generator, c.cutoff, count(*) AS n_selected, count(k.unit) AS n_kept FROM selected s CROSS JOIN (VALUES (4), (5)) c(cutoff)
LEFT JOIN kept k ON k.run_id = s.run_id AND k.unit = s.unit AND k.cutoff = c.cutoff GROUP BY 1, 2""")
def selection_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    return V.selection_sensitivity(_selected(r), r, [4, 5])


@query("""SELECT source, lang, count(*) AS n, count(l.doc_id) AS n_rated, sum(coalesce(quality, 0))::BIGINT AS n_valid,
       sum(coalesce(toxic, 0))::BIGINT AS n_flagged, round(coalesce(sum(quality) / nullif(count(quality), 0)::DOUBLE, 0), 6) AS valid_rate
FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and safety flags of documents by source and language; unrated ones count as neither."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").withColumn("rated", F.lit(1))
    return docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.count("rated").alias("n_rated"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_valid"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("n_flagged"),
        F.round(F.coalesce(F.try_divide(F.sum("quality").cast("double"), F.count("quality")), F.lit(0.0)), 6).alias("valid_rate"),
    )
