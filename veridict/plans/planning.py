"""Planning of further quizzes, audits, and texts that are nearly JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.functions import text as X
from veridict.functions.json_scan import json_error
from veridict.operators import planning as P
from veridict.plans import query
from veridict.sources.tables import SQL_RATINGS, ratings, table

#: Units of runs, where a run is a priority and the order key modulo 40, by what is known of the run's topics (kind).
_SQL_SOURCES = f"""{SQL_RATINGS}, u AS (SELECT run_id AS run, unit, (unit % 40) % 7 AS kind, (row_number() OVER (PARTITION BY run_id ORDER BY unit)) AS pos FROM (SELECT DISTINCT run_id, unit FROM ratings)),
r AS (SELECT DISTINCT run, kind FROM u)"""


@query(f"""WITH {_SQL_SOURCES}
SELECT run, unit::VARCHAR AS question_id, 't' || unit % 4 AS topic, 'topics' AS source, NULL::VARCHAR AS error FROM u WHERE kind = 2 AND unit % 3 <> 0
UNION ALL SELECT run, CASE WHEN unit % 3 = 0 THEN run || '-' || CASE WHEN pos < 1000 THEN lpad(pos::VARCHAR, 3, '0') ELSE pos::VARCHAR END ELSE unit::VARCHAR END, 'q' || unit % 4, 'quiz', NULL FROM u WHERE kind IN (4, 6)
UNION ALL SELECT run, NULL, NULL, CASE WHEN kind IN (1, 3) THEN 'topics' ELSE 'quiz' END,
    CASE kind WHEN 0 THEN 'no_topics_files_and_missing_quiz_jsonl' WHEN 1 THEN 'several unmapped topics files' WHEN 3 THEN 'no_topics_rows' ELSE 'no_topics_found_in_quiz_jsonl' END FROM r WHERE kind IN (0, 1, 3, 5)""")
def sourced_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every run from its topics files, else from its quiz, with all reasons why a run has none."""
    units = ratings(spark, sf_dir).select(F.col("run_id").alias("run"), "unit").distinct().withColumn("kind", F.col("unit") % 40 % 7)
    unit, kind = F.col("unit").cast("string"), F.col("kind")
    topic = lambda t: F.concat(F.lit(t), (F.col("unit") % 4).cast("string"))
    files = units.where("kind in (1, 2, 3)").select(
        "run", F.when(kind != 1, unit).alias("question_id"), F.when((kind == 2) & (F.col("unit") % 3 != 0), topic("t")).alias("topic"),
        F.when(kind == 1, "several unmapped topics files").alias("error"),
    )
    place = F.expr("row_number() over (partition by run order by unit)") - 1
    quiz = units.where("kind in (2, 4, 5, 6)").select(
        "run", place.alias("line"), F.when(F.col("unit") % 3 == 0, " ").otherwise(unit).alias("question_id"), F.when(kind != 5, topic("q")).alias("topic")
    )
    return P.sourced_topics(units.select("run"), files, quiz)


#: A unit's topic says how many judges passed it, so some topics have no valid question; runs are skipped or left untracked by their last digit.
_SQL_ZERO = f"""{SQL_RATINGS}, v AS (SELECT run_id AS run, unit, count(*) AS n, count(*) FILTER (verdict = 'PASS') AS p FROM ratings GROUP BY 1, 2),
q AS (SELECT run, unit, 'passed ' || p AS category, CASE WHEN unit % 40 % 9 = 1 THEN 'no_topics_rows' WHEN unit % 40 % 9 = 2 THEN 'untracked_run' END AS skipped FROM v WHERE unit % 3 > 0),
rated AS (SELECT * FROM ratings WHERE unit % 40 % 8 > 0 AND judge < 7),
c AS (SELECT q.*, (SELECT count(*) FROM rated r WHERE r.run_id = q.run) > 0 AS judged, count(r.judge) AS rows, count(*) FILTER (output_valid AND score >= 2) AS eligible,
    count(*) FILTER (output_valid AND score >= 2 AND verdict = 'PASS') AS passed, count(*) FILTER (output_valid IS FALSE) AS invalid_output, count(*) FILTER (output_valid AND score < 2) AS low
    FROM q LEFT JOIN rated r ON r.run_id = q.run AND r.unit = q.unit GROUP BY ALL),
s AS (SELECT *, CASE WHEN skipped IS NOT NULL THEN 'skipped' WHEN NOT judged THEN 'no_judge_results_found' WHEN eligible = 0 THEN 'no_eligible_judges' WHEN 2 * passed > eligible THEN 'valid' ELSE 'majority_fail' END AS status FROM c),
z AS (SELECT * FROM s WHERE category NOT IN (SELECT category FROM s WHERE status = 'valid')),
e AS (SELECT category, CASE WHEN skipped IS NULL THEN 'included' ELSE 'skipped' END AS part, coalesce(skipped, status) AS key, 1 AS n FROM z
    UNION ALL SELECT category, 'pass/eligible', passed || '/' || eligible, 1 FROM z WHERE status = 'majority_fail'
    UNION ALL SELECT category, 'verdicts', k, CASE k WHEN 'PASS' THEN passed ELSE eligible - passed END FROM z, (VALUES ('PASS'), ('FAIL')) v(k) WHERE status = 'majority_fail'
    UNION ALL SELECT category, 'ineligible', k, CASE k WHEN 'missing_result' THEN 6 - rows WHEN 'invalid_output' THEN invalid_output ELSE low END FROM z, (VALUES ('missing_result'), ('invalid_output'), ('below_min_medical_score')) v(k)
        WHERE status = 'no_eligible_judges')"""


@query(f"""WITH {_SQL_ZERO} SELECT category, part, key, sum(n)::BIGINT AS n FROM e WHERE n > 0 GROUP BY 1, 2, 3
UNION ALL SELECT 'none such', 'included', 'none', 0""")
def zero_valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without a valid question: what became of their questions, votes and runs."""
    given = ratings(spark, sf_dir).withColumnRenamed("run_id", "run")
    units = given.groupBy("run", "unit").agg(F.count_if(F.col("verdict") == "PASS").alias("p"))
    questions = units.where("unit % 3 > 0").select("run", "unit", F.concat(F.lit("passed "), F.col("p").cast("string")).alias("topic"))
    last = F.col("unit") % 40 % 9
    runs = units.where(last != 2).select("run", F.when(last == 1, "no_topics_rows").alias("reason")).distinct()
    targets = questions.select(F.col("topic").alias("category")).distinct().unionByName(spark.createDataFrame([("none such",)], "category string"))
    return P.zero_valid_targets(targets, questions, given.where("unit % 40 % 8 > 0 and judge < 7"), runs, judges=6, min_score=2)


@query(f"""WITH {SQL_RATINGS}, u AS (SELECT generator, unit, count(*) FILTER (judge > 2) AS s, count(*) FILTER (output_valid AND unit % 9 > 0) AS v,
    count(*) FILTER (output_valid AND unit % 9 > 0 AND verdict = 'PASS') AS p FROM ratings GROUP BY 1, 2),
c AS (SELECT generator, CASE WHEN v = 0 THEN 1 WHEN v < 3 THEN 2 WHEN p < 2 THEN 3 ELSE 0 END AS k FROM u WHERE s > 0)
SELECT generator, count(*) AS total, count(*) FILTER (k = 1) AS missing_logical, count(*) FILTER (k = 2) AS insufficient_logical, count(*) FILTER (k = 3) AS failed_pass, count(*) FILTER (k = 0) AS passed
FROM c GROUP BY 1""")
def score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scored units drop out for want of verdicts, and which for want of passes."""
    rated = ratings(spark, sf_dir)
    verdict = F.when(F.col("output_valid") & (F.col("unit") % 9 > 0), F.col("verdict"))
    return P.score_audit(rated.select("generator", "unit", "judge", verdict.alias("verdict"), F.when(F.col("judge") > 2, F.col("score")).alias("score")), 2, 3, "generator")


@query(f"""WITH {SQL_RATINGS}, c AS (SELECT generator, CASE WHEN NOT output_valid THEN 1 WHEN score < 2 THEN 2 WHEN verdict <> 'PASS' THEN 3 ELSE 0 END AS k FROM ratings)
SELECT generator, count(*) AS total, count(*) FILTER (k = 1) AS output_invalid, count(*) FILTER (k = 2) AS low_score, count(*) FILTER (k = 3) AS not_passed, count(*) FILTER (k = 0) AS passed FROM c GROUP BY 1""")
def vote_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judge's vote charged to the first filter that drops it."""
    return P.audit(ratings(spark, sf_dir), {"output_invalid": F.col("output_valid"), "low_score": F.col("score") >= 2, "not_passed": F.col("verdict") == "PASS"}, "generator")


@query("""WITH t AS (SELECT p_brand, p_type FROM part UNION ALL SELECT p_brand, '' FROM part), r AS (SELECT s_suppkey AS request, s_suppkey % 40 AS n, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_nationkey % 5) AS b FROM supplier),
k AS (SELECT DISTINCT request, n, p_type AS topic, md5(request || '|' || p_type) AS h FROM r JOIN t ON b = p_brand WHERE p_type <> '')
SELECT request, row_number() OVER (PARTITION BY request ORDER BY h, topic) AS place, topic FROM k QUALIFY place <= greatest(5, n // 2)""")
def sampled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics drawn for a request of every supplier out of the types of a brand."""
    part = table(spark, sf_dir, "part")
    types = part.groupBy("p_brand").agg(F.array_append(F.collect_set("p_type"), " ").alias("topics"))
    brand = F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 5).cast("string"), (1 + F.col("s_nationkey") % 5).cast("string"))
    requests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request"), (F.col("s_suppkey") % 40).alias("n"), brand.alias("p_brand")).join(types, "p_brand")
    drawn = P.sampled_topics(requests, seed="request").select("request", F.posexplode("sampled").alias("place", "topic"))
    return drawn.select("request", (F.col("place") + 1).cast("long").alias("place"), "topic")


@query("""WITH c AS (SELECT o_custkey AS request, o_orderpriority AS t, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT request, sum(n) AS n, count(*) AS k FROM c GROUP BY 1)
SELECT request, CASE WHEN request % 4 = 1 THEN 'topic_plan length != num_questions' WHEN request % 4 = 2 THEN 'topic_counts sum != num_questions' WHEN request % 4 = 3 THEN 'topic_counts mismatch topic_plan' END AS problem, k AS n_topics FROM r""")
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of customers planned by the priorities of their orders, three quarters of them spoilt."""
    orders, key = table(spark, sf_dir, "orders"), F.col("request")
    plan = orders.groupBy(F.col("o_custkey").alias("request")).agg(F.sort_array(F.collect_list("o_orderpriority")).alias("plan"), F.count("*").alias("n"))  # a customer's orders
    counts = orders.groupBy(F.col("o_custkey").alias("request"), "o_orderpriority").agg(F.count("*").alias("c")).groupBy("request").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "c"))).alias("counts"))
    both = plan.join(counts, "request")
    asked = F.col("n") + F.when(key % 4 == 1, 1).otherwise(0)
    spoilt = F.when(key % 4 == 2, F.map_concat("counts", F.create_map(F.lit("more"), F.lit(1).cast("long")))).when(key % 4 == 3, F.create_map(F.lit("other"), F.col("n"))).otherwise(F.col("counts"))
    return both.select("request", P.plan_problem(F.col("plan"), spoilt, asked).alias("problem"), F.size(P.first_seen_topics(F.col("plan"))).cast("long").alias("n_topics"))


_SQL_AGES = """said AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'A ' || o_custkey || '-year-old man and his ' || (o_orderkey % 90) || ' yo son' WHEN 1 THEN o_custkey || 'year old; 12 years'
    WHEN 2 THEN 'aged 0' || o_custkey || ' YEAR OLD' WHEN 3 THEN 'no age: ' || o_custkey || ' years, yo' END AS text FROM orders)"""


@query(rf"""WITH {_SQL_AGES}, m AS (SELECT k, text, regexp_split_to_array(text, '(?i)\b(\d+)(?:\s*[-\s]?)(?:year-old|year old|yo)\b') AS pieces,
    regexp_extract_all(text, '(?i)\b(\d+)(?:\s*[-\s]?)(?:year-old|year old|yo)\b', 1) AS ages FROM said),
e AS (SELECT k, unnest(ages) AS age, generate_subscripts(ages, 1) AS i FROM m),
n AS (SELECT k, i, (age::BIGINT)::VARCHAR || '.' || lpad(floor(('0x' || substr(md5(k || '|' || (i - 1)), 1, 8))::BIGINT * 80 / 4294967296.0 / 2 + 0.5)::BIGINT::VARCHAR, 3, '0') || ' year-old' AS aged FROM e),
j AS (SELECT m.k, string_agg(aged || pieces[i + 1], '' ORDER BY i) AS rest FROM m JOIN n USING (k) GROUP BY m.k)
SELECT m.k, CASE WHEN rest IS NULL THEN text ELSE pieces[1] || rest END AS text FROM m LEFT JOIN j USING (k)""")
def jittered_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in texts of orders, moved by their key."""
    said = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(
        """CASE o_orderkey % 5 WHEN 0 THEN concat('A ', o_custkey, '-year-old man and his ', o_orderkey % 90, ' yo son') WHEN 1 THEN concat(o_custkey, 'year old; 12 years')
        WHEN 2 THEN concat('aged 0', o_custkey, ' YEAR OLD') WHEN 3 THEN concat('no age: ', o_custkey, ' years, yo') END""").alias("text"))  # fmt: skip
    return said.select("k", X.jittered_ages(F.col("text"), F.col("k")).alias("text"))


#: Turns of conversations as JSON, broken in one of nine ways; what is said is kept to letters, digits and blanks.
_SQL_BROKEN = """c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]+', '', 'g') AS said, (conv_id * 5 + turn) % 9 AS way FROM conversations),
h AS (SELECT *, '{"conv": ' || conv_id || ',' || chr(10) || ' "said": "' AS head FROM c)"""
_BROKEN = [
    # text, expected pos (null: none), message
    ("head || said || '\"}'", "NULL", None), ("head || said", "length(head) - 1", "Unterminated string starting at"), ("head || said || '\"'", "length(head || said) + 1", "Expecting ',' delimiter"),
    ("head || chr(1) || said || '\"}'", "length(head)", "Invalid control character at"), ("head || said || chr(92) || 'x\"}'", "length(head || said)", "Invalid \\escape"),
    ("head || said || '\"} x'", "length(head || said) + 3", "Extra data"), ("replace(head, '\": \"', '\" \"') || said || '\"}'", "length(head) - 2", "Expecting ':' delimiter"),
    ("head || said || '\", x: 1}'", "length(head || said) + 3", "Expecting property name enclosed in double quotes"), ("head || said || '\", \"n\": tru}'", "length(head || said) + 8", "Expecting value"),
]
_by_way = lambda k: "CASE way " + " ".join(f"WHEN {i} THEN {b[k]}" for i, b in enumerate(_BROKEN)) + " END"
_SQL_MESSAGE = "CASE way " + " ".join("WHEN {} THEN '{}'".format(i, b[2].replace("'", "''")) for i, b in enumerate(_BROKEN) if b[2]) + " END"


@query(f"""WITH {_SQL_BROKEN} SELECT conv_id, turn, {_by_way(1)} AS pos, CASE WHEN way > 0 THEN 2 END AS line, {_SQL_MESSAGE} AS message FROM h""")
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where turns that are nearly JSON stop being it."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9 ]+", "").alias("said"), ((F.col("conv_id") * 5 + F.col("turn")) % 9).alias("way"))
    head = F.concat(F.lit('{"conv": '), F.col("conv_id").cast("string"), F.lit(',\n "said": "'))
    whole = lambda *parts: F.concat(head, *(F.col("said") if p is None else F.lit(p) for p in parts))
    texts = [
        whole(None, '"}'), whole(None), whole(None, '"'), whole("\x01", None, '"}'), whole(None, '\\x"}'), whole(None, '"} x'),
        F.concat(F.replace(head, F.lit('": "'), F.lit('" "')), F.col("said"), F.lit('"}')), whole(None, '", x: 1}'), whole(None, '", "n": tru}'),
    ]
    text = F.coalesce(*(F.when(F.col("way") == k, t) for k, t in enumerate(texts)))
    return said.select("conv_id", "turn", json_error(text).alias("e")).select("conv_id", "turn", "e.pos", "e.line", "e.message")
