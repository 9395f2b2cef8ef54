"""Quota subsets, plans and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.operators import subset as Q
from veridict.plans import query
from veridict.sources.tables import part_topics

_TARGETS = [("ECONOMY", 7, 0), ("PROMO", 3, 1), ("STANDARD", 5, 2), ("absent", 2, 3), ("SMALL", 0, 4)]
_SQL = """targets AS (SELECT * FROM (VALUES ('ECONOMY', 7, 0), ('PROMO', 3, 1), ('STANDARD', 5, 2), ('absent', 2, 3), ('SMALL', 0, 4)) v(category, target, ord)),
candidates AS (SELECT p_partkey AS question_id, p_brand AS generator, upper(split_part(p_type, ' ', 1)) AS category, p_size FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY generator, category ORDER BY p_size, question_id)::INT AS rn FROM candidates JOIN targets USING (category)),
picked AS (SELECT * FROM ranked WHERE rn <= target),
indexed AS (SELECT *, (row_number() OVER (PARTITION BY generator ORDER BY rn, ord) - 1)::INT AS index FROM picked)"""


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TARGETS, "category string, target int, ord int")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.upper(F.get(F.split("topic", " "), F.lit(0)))
    return part_topics(spark, sf_dir).select("question_id", "generator", first.alias("category"), "p_size")


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.select_quota(_candidates(spark, sf_dir), _targets(spark), ["p_size", "question_id"], "generator")


@query(f"WITH {_SQL} SELECT generator, category, question_id, rn FROM picked")
def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("generator", "category", "question_id", "rn")


@query(f"WITH {_SQL} SELECT generator, index, question_id, (index // 4)::INT AS chunk, index % 4 + 1 AS place, printf('abms-p%02d-%03d', (index // 4)::INT, (index % 4 + 1)::INT) AS chunk_id FROM indexed")
def interleaved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = Q.interleave(_selected(spark, sf_dir), "generator")
    return Q.chunk(mixed, 4, "abms").select("generator", "index", "question_id", "chunk", "place", "chunk_id")


@query(f"""WITH {_SQL}, n AS (SELECT g.generator, t.category, t.target, count(c.question_id) AS n FROM (SELECT DISTINCT generator FROM candidates) g, targets t
    LEFT JOIN candidates c ON c.generator = g.generator AND c.category = t.category GROUP BY 1, 2, 3)
SELECT generator, category, target, n, target - n AS missing FROM n WHERE n < target""")
def quota_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.shortfall(_candidates(spark, sf_dir), _targets(spark).select("category", "target"), "generator")


@query("""WITH t AS (SELECT p_type AS category, count(*) FILTER (p_size < 5)::INT AS target, row_number() OVER (ORDER BY p_type) AS ord FROM part GROUP BY 1)
SELECT (row_number() OVER (ORDER BY ord, k) - 1)::BIGINT AS position, category FROM (SELECT *, unnest(range(target)) AS k FROM t)""")
def expanded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each small part, by type; types without one have none."""
    counts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_type").alias("category")).agg(F.count_if(F.col("p_size") < 5).cast("int").alias("target"))
    targets = counts.withColumn("ord", F.row_number().over(Window.orderBy("category")))  # one row a type
    return Q.expand(targets).select(F.col("position").cast("long"), "category")


@query("SELECT s_nationkey AS generator, min(s_suppkey) AS question_id FROM supplier GROUP BY 1")
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of every key across duplicates."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("generator"), F.col("s_suppkey").alias("question_id"))
    return Q.first_by_priority(rows, ["generator"], ["question_id"])
