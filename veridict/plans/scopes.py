"""Scopes, allow-lists, topics of valid questions, and bookkeeping of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.operators import scopes as S
from veridict.operators import subset as B
from veridict.operators import validity as V
from veridict.plans import query
from veridict.sources.tables import SQL_ANSWERS, SQL_ATTEMPTS, SQL_LINES, SQL_RATINGS, answers, attempts, ratings, table

_RATED = SQL_RATINGS
_RUN = "o_orderpriority || '/' || (o_orderkey % 40)"
_QUESTIONS = f"questions AS (SELECT {_RUN} AS run_id, o_orderkey AS unit, o_orderpriority AS generator FROM orders)"
_TOPICS = f"""topics AS (SELECT {_RUN} AS run_id, o_orderkey AS unit, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS topic
    FROM orders WHERE o_orderkey % 40 < 30)"""
_VALID = """accepted AS (SELECT run_id, unit FROM ratings GROUP BY 1, 2
    HAVING 2 * count(*) FILTER (output_valid AND score >= 2 AND verdict = 'PASS') > count(*) FILTER (output_valid AND score >= 2))"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.concat_ws("/", "o_orderpriority", (F.col("o_orderkey") % 40).cast("string"))
    return table(spark, sf_dir, "orders").select(
        run.alias("run_id"), F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("generator"), "o_orderstatus"
    )


def _topics(questions: DataFrame) -> DataFrame:
    """Topics of some runs, null for some questions."""
    topic = F.when(F.col("unit") % 5 != 0, F.col("o_orderstatus"))
    return questions.where("unit % 40 < 30").select("run_id", "unit", topic.alias("topic"))


@query(f"WITH {_RATED}, {_QUESTIONS}, {_TOPICS}, {_VALID} SELECT generator, topic, count(*) AS n FROM questions SEMI JOIN accepted USING (run_id, unit) JOIN topics USING (run_id, unit) WHERE topic IS NOT NULL GROUP BY 1, 2")
def valid_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return S.valid_topics(q, V.accepted_units(ratings(spark, sf_dir), min_score=2), _topics(q))


@query(f"""WITH {_RATED}, {_QUESTIONS}, {_TOPICS}, few AS (SELECT DISTINCT run_id FROM ratings WHERE unit % 40 > 4)
SELECT generator, run_id, count(*) AS n_questions, CASE WHEN run_id NOT IN (FROM few) THEN 'no_ratings'
       WHEN run_id NOT IN (SELECT run_id FROM topics WHERE topic IS NOT NULL) THEN 'no_topics' ELSE 'included' END AS status FROM questions GROUP BY 1, 2""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return S.run_status(q, ratings(spark, sf_dir).where("unit % 40 > 4"), _topics(q))


@query(f"""WITH {_RATED}, {_QUESTIONS}, {_TOPICS}, {_VALID}, m AS (SELECT q.*, topic, a.unit IS NOT NULL AS ok FROM questions q
    LEFT JOIN topics USING (run_id, unit) LEFT JOIN accepted a USING (run_id, unit)),
s AS (SELECT 'all' AS scope, * FROM m UNION ALL SELECT 'valid', * FROM m WHERE ok),
c AS (SELECT scope, generator, topic, count(*) AS n, (sum(count(*)) OVER (PARTITION BY scope, generator))::BIGINT AS total FROM s GROUP BY 1, 2, 3)
SELECT * FROM c WHERE topic IS NOT NULL""")
def accumulated_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    accepted = V.accepted_units(ratings(spark, sf_dir), min_score=2)
    return S.accumulated_topics(q.drop("o_orderstatus"), accepted, _topics(q))


@query(f"""WITH {SQL_ATTEMPTS}, holes AS (SELECT item, llm, CASE WHEN llm <> 2 THEN CASE WHEN llm = 3 THEN topic || '?' ELSE topic END END AS topic,
    CASE WHEN llm > 1 THEN quiz END AS quiz FROM attempts)
SELECT item, arg_min(topic, llm) FILTER (topic IS NOT NULL) AS topic, arg_min(quiz, llm) FILTER (quiz IS NOT NULL) AS quiz,
       count(DISTINCT topic) AS n_topics, count(DISTINCT quiz) AS n_quizzes FROM holes GROUP BY 1""")
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First label and quiz of every item that are not missing, with the number of different ones."""
    llm = F.col("llm")
    other = F.when(llm != 2, F.when(llm == 3, F.concat("topic", F.lit("?"))).otherwise(F.col("topic")))
    holes = attempts(spark, sf_dir).select("item", "llm", other.alias("topic"), F.when(llm > 1, F.col("quiz")).alias("quiz"))
    return S.item_metadata(holes, "llm")


@query(f"""WITH {SQL_ATTEMPTS}, f AS (SELECT topic FROM attempts GROUP BY 1 HAVING count(DISTINCT item) >= 3)
SELECT topic, count(*) AS n FROM attempts SEMI JOIN f USING (topic) GROUP BY 1""")
def frequent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frequent_topics(attempts(spark, sf_dir), 3).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_LINES}, {SQL_ANSWERS} SELECT 'allowed' AS rule, count(*) AS n FROM answers WHERE model IN ('m1', 'm3')
UNION ALL SELECT 'no_list', count(*) FROM answers
UNION ALL SELECT 'glob', count(*) FROM answers WHERE run_id LIKE '1-%/1_' UNION ALL SELECT 'glob_without_match', count(*) FROM answers
UNION ALL SELECT 'first_runs', count(*) FROM answers WHERE run_id IN (SELECT run_id FROM (SELECT DISTINCT run_id FROM answers) ORDER BY run_id LIMIT 5)
UNION ALL SELECT 'by_judges', count(*) FROM answers WHERE generator IN ('1-URGENT', '4-NOT SPECIFIED')
UNION ALL SELECT 'default_models', count(*) FROM answers WHERE model IN ('m2', 'm5') UNION ALL SELECT 'default_models_none', count(*) FROM answers
UNION ALL SELECT 'contains', count(*) FROM answers WHERE contains(lower(generator), 'urgent') OR contains(model, '7')
UNION ALL SELECT 'without_examples', count(*) FROM answers WHERE generator <> '5-LOW'""")
def scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each rule of a scope keeps."""
    a = answers(spark, sf_dir).select("run_id", "generator", "unit", "model")
    judges = spark.createDataFrame([(" 1-URGENT ",), ("4-NOT-SPECIFIED",), ("",), (None,)], "judge string")
    named = a.withColumn("generator", F.when(F.col("unit") % 2 == 0, "m2").otherwise("m5"))
    kept = {
        "allowed": S.allowed(a, "model", S.listed(" m1, m3,")), "no_list": S.allowed(a, "model", S.listed(None)), "glob": S.matching_runs(a, "1-*/1?"),
        "glob_without_match": S.matching_runs(a, "none*"), "first_runs": S.first_runs(a, 5),
        "by_judges": S.by_judges(a, judges.union(spark.createDataFrame([("4-NOT SPECIFIED",)], "judge string"))),
        "default_models": S.default_models(named), "default_models_none": S.default_models(a), "contains": S.contains_text(S.first_runs(a, None), "URGENT", "generator").union(
            S.contains_text(a, "7", "model").where("not contains(lower(generator), 'urgent')")), "without_examples": S.without_examples(a, "5-LOW"),
    }
    out = None
    for rule, rows in kept.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL OR c_custkey % 3 = 0 THEN 'unknown' ELSE c_mktsegment END AS segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return S.with_default(orders, known, ["key"], "segment").select("id", "segment")


@query("SELECT o_orderkey AS unit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 > 0)")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"))
    known = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("unit")).distinct()
    return S.unknown_references(units, known, "unit")


@query("""WITH r AS (SELECT p_brand AS generator, max(CASE WHEN p_size % 7 <> 0 AND p_size < 5 + p_partkey % 40 THEN p_size END) AS seed FROM part GROUP BY 1)
SELECT generator, greatest(10, coalesce(seed + 1, 10)) - 10 AS start FROM r""")
def next_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much new seeds of a brand are above 10, where part sizes are the seeds used (some are not stated)."""
    seed = F.when((F.col("p_size") % 7 != 0) & (F.col("p_size") < 5 + F.col("p_partkey") % 40), F.col("p_size"))
    return S.next_seed(table(spark, sf_dir, "part").select(F.col("p_brand").alias("generator"), seed.alias("seed")), 10)


_FILES = """f AS (SELECT 'q' || o_custkey AS quiz_id, 'p' || o_orderkey AS path, o_orderkey % 5 AS modified, o_orderkey % 3 AS kind FROM orders)"""


def _order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of their customers' quizzes; many were changed at the same time."""
    key, text = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, sf_dir, "orders").select(text("q", "o_custkey").alias("quiz_id"), text("p", "o_orderkey").alias("path"), (key % 5).alias("modified"), (key % 3).alias("kind"))


@query(f"""WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY quiz_id, kind = 0 ORDER BY modified DESC, path DESC) AS k FROM f),
n AS (SELECT quiz_id, max(path) FILTER (kind = 0) AS a, max(path) FILTER (kind <> 0) AS b FROM r WHERE k = 1 GROUP BY 1) SELECT quiz_id, coalesce(a, b) AS path FROM n""")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file of every customer that a manifest names, else the newest found."""
    files = _order_files(spark, sf_dir)
    return S.newest_file(files.where("kind = 0").drop("kind"), files.where("kind <> 0").drop("kind"))


@query(f"""WITH {_FILES}, n AS (SELECT *, CASE WHEN kind = 0 THEN 'm.json' ELSE path || '.json' END AS file_name FROM f)
SELECT quiz_id AS generator, path FROM n QUALIFY row_number() OVER (PARTITION BY quiz_id ORDER BY kind = 0 DESC, modified DESC, file_name DESC, path DESC) = 1""")
def base_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of every customer to begin from: the one of the preferred name, else the newest."""
    name = F.when(F.col("kind") == 0, "m.json").otherwise(F.concat("path", F.lit(".json")))
    return S.base_manifest(_order_files(spark, sf_dir).select(F.col("quiz_id").alias("generator"), name.alias("file_name"), "path", "modified"), "m.json")


@query("""WITH w AS (SELECT p_brand AS generator, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size > 10),
t AS (SELECT p_brand AS generator, list_sort(list(DISTINCT p_type) FILTER (p_size > 30 AND p_size > 10)) AS t FROM part WHERE p_size > 10 GROUP BY 1)
SELECT generator, array_to_string(q, ',') AS quizzes, coalesce(array_to_string(t, ','), '') AS topics FROM (SELECT generator, list_sort(list(DISTINCT w)) AS q FROM w GROUP BY 1) JOIN t USING (generator)""")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the names of a brand's parts, and types of its large ones, as merged lists."""
    parts = table(spark, sf_dir, "part").where("p_size > 10")
    topics = F.when(F.col("p_size") > 30, F.array("p_type"))
    lists = parts.select(F.col("p_brand").alias("generator"), F.split("p_name", " ").alias("quizzes"), topics.alias("topics"))
    merged = S.merged_lists(lists, "generator", "quizzes", "topics")
    return merged.select("generator", *(F.array_join(c, ",").alias(c) for c in ("quizzes", "topics")))


_COUNTS = "c AS (SELECT p_brand AS generator, p_type AS topic, count(*) AS n FROM part GROUP BY 1, 2)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("generator"), F.col("p_type").alias("topic")).agg(F.count("*").alias("n"))


@query(f"""WITH {_COUNTS}, s AS (SELECT generator, topic, round(n / sum(n) OVER (PARTITION BY generator), 6) AS share FROM c WHERE generator IN ('Brand#11', 'Brand#12'))
SELECT topic, coalesce(max(share) FILTER (generator = 'Brand#11'), 0)::DOUBLE AS share_Brand_11, coalesce(max(share) FILTER (generator = 'Brand#12'), 0)::DOUBLE AS share_Brand_12
FROM s GROUP BY 1""")
def topic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.topic_table(_counts(spark, sf_dir), ["Brand#11", "Brand#12"])


@query(f"""WITH {_COUNTS}, t AS (SELECT topic, sum(n)::BIGINT AS n, sum(n) / sum(sum(n)) OVER () AS share FROM c GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, topic) AS k FROM t WHERE topic NOT IN ('PROMO', 'none'))
SELECT 'target' AS part, v.topic, coalesce(n, 0)::BIGINT AS n, coalesce(round(share, 6), 0)::DOUBLE AS share FROM (VALUES ('PROMO'), ('none')) v(topic) LEFT JOIN t USING (topic)
UNION ALL SELECT 'extra', topic, n, round(share, 6) FROM o WHERE k <= 2
UNION ALL SELECT 'rest', count(*)::VARCHAR, sum(n)::BIGINT, round(sum(round(share, 6)), 6) FROM o WHERE k > 2 HAVING count(*) > 0""")
def current_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.current_topics(_counts(spark, sf_dir).drop("generator"), ["PROMO", "none"], 2)


@query("""SELECT topic, source, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS topic,
       CASE o_orderkey % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'mapped' ELSE 'unassigned' END AS source FROM orders) GROUP BY 1, 2""")
def specialties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    chosen = S.specialty(F.when(k == 0, F.col("o_orderstatus")).otherwise("  "), F.when(k < 2, F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(chosen.alias("s")).groupBy("s.topic", "s.source").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS place, s_nationkey::VARCHAR AS category FROM supplier), n AS (SELECT count(*)::INT AS n FROM s)
SELECT r::INT AS place, category FROM range(1000) v(r), n JOIN s ON s.place = r % n.n""")
def repeated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of the suppliers' nations, repeated up to a thousand places."""
    plan = table(spark, sf_dir, "supplier").select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("place"), F.col("s_nationkey").cast("string").alias("category"))
    return B.repeat_plan(plan, 1000)


@query(f"""WITH {SQL_RATINGS}, r AS (SELECT DISTINCT run_id FROM ratings) SELECT run_id FROM r WHERE split_part(run_id, '/', 2)::INT % 4 IN (0, 1)""")
def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that the manifests of a tag list, or the manifest without one; other tags' runs are left out."""
    runs = ratings(spark, sf_dir).select("run_id").distinct()
    k = F.split("run_id", "/")[1].cast("int") % 4
    name = F.when(k == 0, "quizbench_manifest_T_2.json").when(k == 1, "quizbench_manifest.json").when(k == 2, "quizbench_manifest_S.json").otherwise("other_T.json")
    return S.of_batch(runs, runs.select(F.col("run_id").alias("quiz_id"), name.alias("file_name")), "T", run="run_id")
