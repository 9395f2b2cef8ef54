"""Scalar rules and parsing of model output over texts made from the given tables.

What a row says is made from its own columns: the SQL side knows what was meant
and never sees the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.functions import model_output as M
from veridict.functions import text as X
from veridict.operators import ingest
from veridict.operators.stats import t_quantile
from veridict.plans import query
from veridict.sources.tables import table


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """SQL for a literal table."""
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) v({columns})"


_LINE = """line AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_returnflag) AS f
    FROM lineitem GROUP BY 1, 2)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of an order: keys o and n, and p, s, q, f of the line."""
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return each.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))


def _pick(key: Column, choices: list) -> Column:
    """The choice whose place is key modulo their number."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(key, F.lit(len(choices))) + 1).cast("int"))


def _sql_pick(key: str, choices: list) -> str:
    return f"CASE ({key}) % {len(choices)} " + " ".join(f"WHEN {k} THEN {_sql(c)}" for k, c in enumerate(choices)) + " END"


def _filled(template: Column, **parts: Column) -> Column:
    for name, part in parts.items():
        template = F.replace(template, F.lit(f"<{name}>"), part)
    return template


def _sql_filled(template: str, **parts: str) -> str:
    for name, part in parts.items():
        template = f"replace({template}, '<{name}>', {part})"
    return template


FUNCTIONS = {
    "answer_letter": X.answer_letter, "answer_letter_of_ten": X.answer_letter_of_ten, "family": X.provider_family,
    "exact": lambda x: X.provider_family(x, "exact"), "file_name": X.safe_file_name, "suffix": X.safe_suffix, "id": X.safe_id,
    "slug": X.model_slug, "custom_id": X.custom_id, "generator_of": lambda x: X.generator_of(x, F.lit("")), "json_block": X.json_block,
    "panel": X.surgical_panel, "short_topic": X.short_topic, "batch_tag": X.batch_tag, "blood_or_cancer": X.blood_or_cancer,
    "options": lambda x: X.repaired_options(x).cast("string"), "body_text": M.body_text,
}
#: (function, text, what it means): <A> and <B> are two letters of a line from A to E, <a> the first in lower case, <n> its part.
SAYINGS = [
    ("answer_letter", "The answer is <A>", "<A>"), ("answer_letter", "answer is <A>, not <B>", "<B>"), ("answer_letter", "ANSWER : <a>", "<A>"),
    ("answer_letter", "answer=<A> or <B>", "<B>"), ("answer_letter", "I choose (<A>)  ", "<A>"), ("answer_letter", "(<A>) is right, I think", None),
    ("answer_letter", "The answer is (Z). Answer: <A>", None), ("answer_letter", "none at all of <n>", None), ("answer_letter", "the  answer\nis ( <a> )", "<A>"),
    ("answer_letter", "So <A> it is, part <n>", "<A>"), ("answer_letter", None, None),
    ("answer_letter_of_ten", "The answer is (<A>).", "<A>"), ("answer_letter_of_ten", "Answer:\t<A>", "<A>"), ("answer_letter_of_ten", "ANSWER: <A>", None),
    ("answer_letter_of_ten", "best course of action to perform immediately is [<A>]", "<A>"),
    ("answer_letter_of_ten", "The best course of action here would be (<A>) or (<B>)", "<B>"), ("answer_letter_of_ten", "an action that is best: (<A>)", "<A>"),
    ("answer_letter_of_ten", "I like <A>", None), ("answer_letter_of_ten", "Answer: J, not <A>", "J"),
    ("family", "gpt-<n>.1", "openai"), ("family", "gpt<n>", "gpt<n>"), ("family", "OpenAI-<n>", "openai"), ("family", "o<n>-mini", "o<n>-mini"),
    ("family", "anthropic/claude<n>", "anthropic"), ("family", "Claude-<n>", "anthropic"), ("family", "Gemini-<n>", "gemini"), ("family", "google-<n>", "gemini"),
    ("family", "grok-<n>", "grok-<n>"), ("family", "", "unknown"), ("family", None, "unknown"), ("exact", "gpt-<n>", "gpt-<n>"), ("exact", None, "unknown"),
    ("file_name", " a b/<n>: ", "a_b_<n>_"), ("suffix", " .<a> <n>_. ", "<a>_<n>"), ("suffix", None, ""), ("id", " ?? ", "unknown"), ("id", "x/<n>", "x_<n>"),
    ("slug", "-<a> <n>-", "<a>-<n>"), ("slug", "//", "model"), ("slug", "_<a>.<n>_", "_<a>.<n>_"),
    ("custom_id", "q <n>/é", "q-<n>--"), ("custom_id", "<a><a><a>_<n>", "<a><a><a>_<n>"),
    ("generator_of", "20260101T000000000Z_gpt-<n>_x_seed3", "gpt-<n>_x"), ("generator_of", "any_gen<n>_seedling", "gen<n>"),
    ("generator_of", "gen_seed<n>", "unknown"), ("generator_of", "a__seed<n>", "unknown"), ("generator_of", "a_b_<n>", "unknown"),
    ("json_block", "x ```json\n{\"a\": <n>}\n``` y {", '{"a": <n>}'), ("json_block", "```\nplain <n>\n```", "```\nplain <n>\n```"),
    ("json_block", "a [<n>] b {2} c", "[<n>]"), ("json_block", " none <n> ", "none <n>"),
    ("panel", "Orthopedic  SURGERY <n>", "surgical"), ("panel", "Urology", "surgical"), ("panel", "Urology <n>", "medicine"), ("panel", "Obstetrics <n>", "surgical"),
    ("panel", "Emergency Medicine", "other"), ("panel", "unknown <n>", "medicine"), ("panel", None, "medicine"),
    ("short_topic", " Physical  Medicine and rehabilitation", "PM&R"), ("short_topic", "New  topic <n>", "New topic <n>"), ("short_topic", None, ""),
    ("batch_tag", "a/quizzes_<a>1/quizzes_<n>/runs", "<n>"), ("batch_tag", "a/<n>", None),
    ("blood_or_cancer", "`Hematology`", "Hematology"), ("blood_or_cancer", "\"oncology\"\nmore <n>", "Medical Oncology"),
    ("blood_or_cancer", "It is medical  oncology, not hematology <n>", "Medical Oncology"), ("blood_or_cancer", "hematology or oncology <n>", None),
    ("options", "[“<a>”, \"N/A\", \"<n>\"]", "[<a>, <n>]"), ("options", "no array <n>", None),
    ("body_text", '{"output_text": "<A>"}', "<A>"),
    ("body_text", '{"output_text": " ", "output": [{"type": "message", "content": [{"type": "text", "text": "<A>"}, {"type": "x", "text": "no"}]}, {"type": "text", "text": "<B>"}, 7]}', "<A><B>"),
    ("body_text", '{"choices": [{"message": {"content": "<A>"}}]}', "<A>"),
    ("body_text", '{"choices": [{"message": {"content": [{"type": "text", "text": "<A>"}, {"type": "image"}, {"type": "text", "text": "<n>"}]}}]}', "<A><n>"),
    ("body_text", '{"choices": [{"message": {}}]}', ""), ("body_text", '{"other":<n>}', '{"other":<n>}'), ("body_text", '"<A>"', "<A>"), ("body_text", "<A> <n>", "<A> <n>"),
]
_SQL_PARTS = {"A": "chr((65 + p % 5)::INT)", "a": "chr((97 + p % 5)::INT)", "B": "chr((65 + (p + 2) % 5)::INT)", "n": "p::VARCHAR"}


def _parts() -> dict[str, Column]:
    p = F.col("p")
    return {"A": F.char(65 + p % 5), "a": F.char(97 + p % 5), "B": F.char(65 + (p + 2) % 5), "n": p.cast("string")}


@query(f"""WITH {_LINE} SELECT o, n, {_sql_pick("o * 7 + n", [f for f, _, _ in SAYINGS])} AS function,
    {_sql_filled(_sql_pick("o * 7 + n", [m for _, _, m in SAYINGS]), **_SQL_PARTS)} AS result FROM line""")
def scalar_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar rule over what order lines say in forms that are easy to get wrong."""
    key = F.col("o") * 7 + F.col("n")
    said = _lines(spark, sf_dir).select("o", "n", _pick(key, [f for f, _, _ in SAYINGS]).alias("function"), _filled(_pick(key, [t for _, t, _ in SAYINGS]), **_parts()).alias("input"))
    result = F.coalesce(*(F.when(F.col("function") == f, rule(F.col("input"))) for f, rule in FUNCTIONS.items()))
    return said.select("o", "n", "function", result.alias("result"))


@query("""WITH v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN p_size::DOUBLE / 8 END AS v, (p_partkey % 4)::DOUBLE AS low, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 7)::DOUBLE END AS high FROM part)
SELECT k, CASE WHEN k % 17 <> 0 AND v IS NOT NULL AND high > low THEN round_even((least(high, greatest(low, v)) - low) / (high - low) * 4, 0)::INT END AS level FROM v""")
def heat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of part sizes between bounds that may be equal, the wrong way round, missing or no number."""
    k = F.col("p_partkey")
    v = F.when(k % 17 == 0, float("nan")).when(k % 11 != 0, F.col("p_size") / 8.0)
    low, high = (k % 4).cast("double"), F.when(k % 13 != 0, (k % 7).cast("double"))
    return table(spark, sf_dir, "part").select(k.alias("k"), X.heat_level(v, low, high).alias("level"))


#: Forms of a judge's response, and the error that each means: <s> is a score from 1 to 5, <v> the validity, <r> its reason.
_FINE = '"analysis": "x", "medical_accuracy_score": <s>, "logical_validity": <v>, "logical_false_reason": "<r>"'
JUDGEMENTS = [
    ("{" + _FINE + "}", None), ("Here: ```json\n{" + _FINE.replace('"<r>"', '" <r> "') + "}\n```", None), ("{" + _FINE.replace("<s>", '"<s>"') + "}", None),
    ("{" + _FINE.replace("<s>", "<s>.9") + "}", None), ("no json", "json decode error"), ("[<s>]", "Parsed JSON is not an object"),
    ('{"analysis": "x"}', "a required field is missing"), ("{" + _FINE.replace('"x"', "7") + "}", "analysis must be a string"),
    ("{" + _FINE.replace("<v>", '"<v>"') + "}", "logical_validity must be a boolean"),
    ("{" + _FINE.replace("<r>", "Q") + "}", "logical_false_reason must be one of C/N/M/U/K/T"),
    ("{" + _FINE.replace('"<r>"', "null") + "}", "logical_false_reason must be one of C/N/M/U/K/T"),
    ("{" + _FINE.replace("<s>", '"high"') + "}", "medical_accuracy_score must be an integer between 1 and 5"),
    ("{" + _FINE.replace("<s>", "<s>0") + "}", "medical_accuracy_score must be between 1 and 5"),
    ("{" + _FINE.replace("<v>", "true").replace("<r>", "C") + "}", "logical_false_reason must be T when logical_validity is true"),
    ("{" + _FINE.replace("<v>", "false").replace("<r>", "T") + "}", "logical_false_reason must be C/N/M/U/K when logical_validity is false"),
]
_SQL_REASON = _sql_pick("p", list("CNMUK"))


@query(f"""WITH {_LINE}, j AS (SELECT o, n, {_sql_pick("o * 7 + n", [e for _, e in JUDGEMENTS])} AS error, f <> 'R' AS fine, {_SQL_REASON} AS reason, (1 + floor((q - 1) / 10))::INT AS score FROM line)
SELECT o, n, error IS NULL AS output_valid, error AS parse_error, CASE WHEN error IS NULL THEN CASE WHEN fine THEN 'PASS' ELSE 'FAIL' END END AS verdict,
       CASE WHEN error IS NULL THEN CASE WHEN fine THEN 'NA' ELSE reason END END AS fail_reason, CASE WHEN error IS NULL THEN score END AS score FROM j""")
def judge_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' JSON about every order line, in all forms, and the verdicts that follow from it."""
    fine = F.col("f") != "R"
    form = _pick(F.col("o") * 7 + F.col("n"), [t for t, _ in JUDGEMENTS])
    score = F.floor(1 + (F.col("q") - 1) / 10).cast("string")
    raw = _filled(form, s=score, v=fine.cast("string"), r=F.when(fine, "T").otherwise(_pick(F.col("p"), list("CNMUK"))))
    return ingest.ratings_of(_lines(spark, sf_dir).select("o", "n", raw.alias("raw"))).drop("logical_false_reason")


_BOOLEANS = [("true", True), ("false", False), ('"False "', False), ('" TRUE"', True), ('"yes"', None), ("1", None), ("null", None), ("[true]", None)]


@query(f"""WITH {_LINE}, b AS (SELECT o, n, {_sql_pick("o + n", [v for _, v in _BOOLEANS])} AS value FROM line)
SELECT o, n, value, CASE WHEN value IS NULL THEN 'safety_flag must be a boolean' END AS error FROM b""")
def booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of order lines, as JSON and as text."""
    flag = M.boolean_of(_pick(F.col("o") + F.col("n"), [t for t, _ in _BOOLEANS]))
    return _lines(spark, sf_dir).select("o", "n", flag.alias("b")).select("o", "n", "b.value", "b.error")


def _quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quiz an order, an item a line: some items lack a field or have another letter, some responses are fenced, quoted or no quiz."""
    letter = F.when(F.col("s") % 7 == 0, "F").otherwise(F.concat(F.char(97 + F.col("p") % 5), F.lit(" ")))
    last = F.when(F.col("s") % 11 == 0, F.lit("}")).otherwise(F.lit(', "explanation": "Because."}'))
    item = F.concat(F.lit('{"question": "Q'), F.col("n").cast("string"), F.lit('", "options": ["A", "B", "C", "D", "E"], "answer": "'), letter, F.lit('"'), last)
    each = _lines(spark, sf_dir).select("o", F.struct("n", item.alias("item"), F.when(F.col("p") % 3 != 0, F.concat(F.lit("t"), (F.col("p") % 9).cast("string"))).otherwise(" ").alias("topic")).alias("e"))
    per = each.groupBy("o").agg(F.sort_array(F.collect_list("e")).alias("es"))  # an order's lines are few
    body = F.concat(F.lit('{"items": ['), F.array_join(F.col("es.item"), ", "), F.lit("]}"))
    raw = F.when(F.col("o") % 9 == 0, "sorry").when(F.col("o") % 10 == 1, '{"none": 1}').when(F.col("o") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
    raw = raw.when(F.col("o") % 4 == 2, F.replace(body, F.lit('"items"'), F.lit("“items”"))).otherwise(body)
    return per.select(F.concat(F.lit("q"), F.col("o").cast("string")).alias("quiz_id"), F.col("es.topic").alias("target_topics"), raw.alias("raw"), "o")


_SQL_QUIZ = f"""{_LINE}, item AS (SELECT o, n, p, row_number() OVER (PARTITION BY o ORDER BY n) AS k FROM line WHERE s % 7 <> 0 AND s % 11 <> 0 AND o % 9 <> 0 AND o % 10 <> 1)"""


@query(f"""WITH {_SQL_QUIZ} SELECT 'q' || o AS quiz_id, 'q' || o || '-' || lpad(k::VARCHAR, 3, '0') AS question_id, 'Q' || n AS question, chr((65 + p % 5)::INT) AS answer, (p % 5)::INT AS answer_index,
    5 AS n_options, CASE WHEN p % 3 <> 0 THEN 't' || (p % 9) END AS target_topic FROM item""")
def quiz_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable items of the quizzes of orders, numbered among themselves, with the topic of their place in the response."""
    found = ingest.quiz_items(_quizzes(spark, sf_dir))
    return found.select("quiz_id", "question_id", "question", "answer", "answer_index", F.size("options").alias("n_options"), "target_topic")


@query(f"""WITH {_SQL_QUIZ}, c AS (SELECT o, count(*) AS n FROM item GROUP BY 1), t AS (SELECT DISTINCT o FROM line WHERE o % 8 <> 3)
SELECT 'q' || r.o_orderkey AS quiz_id, CASE WHEN c.n > 0 AND t.o IS NOT NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN t.o IS NOT NULL THEN coalesce(c.n, 0) ELSE 0 END::INT AS n_items,
    CASE WHEN t.o IS NULL THEN 'no result returned' WHEN r.o_orderkey % 9 = 0 THEN 'Could not parse JSON for quiz q' || r.o_orderkey
        WHEN c.n IS NULL THEN 'Generator returned zero valid items for q' || r.o_orderkey END AS error
FROM orders r LEFT JOIN t ON t.o = r.o_orderkey LEFT JOIN c ON c.o = r.o_orderkey""")
def quiz_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the quiz of every order, where some have no response."""
    requests = table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("quiz_id"))
    return ingest.quiz_status(requests, _quizzes(spark, sf_dir).where("o % 8 <> 3"))


_BATCH = """item AS (SELECT l_orderkey || '_' || l_linenumber AS custom_id, l_orderkey % 7 AS k, l_linenumber AS run, min(l_returnflag) AS category,
    chr((65 + min(l_partkey) % 5)::INT) AS answer, chr((65 + min(l_suppkey) % 6)::INT) AS said FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_PRED = "CASE WHEN k IN (0, 1) OR said = 'F' THEN NULL ELSE said END"


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a batch over all order lines: some without a line, some with an error, the others with bodies of four shapes."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    item = line.agg(
        F.min("l_returnflag").alias("category"), F.char(65 + F.min("l_partkey") % 5).alias("answer"), F.char(65 + F.min("l_suppkey") % 6).alias("_said")
    )
    item = item.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("custom_id"), (F.col("l_orderkey") % 7).alias("k"),
        F.col("l_linenumber").alias("run"), "category", "answer", "_said",
    )
    text = F.concat(F.lit("Think. The answer is **("), F.col("_said"), F.lit(")**"))
    shaped = lambda before, after: F.concat(F.lit('{"response": {"body": ' + before + '"'), text, F.lit('"' + after + "}}"))
    line = (
        F.when(F.col("k") == 1, '{"error": {"code": "busy"}}').when(F.col("k") == 2, shaped('{"output_text": ', "}"))
        .when(F.col("k") == 3, shaped('{"output": [{"type": "message", "content": [{"type": "output_text", "text": ', "}]}]}"))
        .when(F.col("k") == 4, shaped('{"choices": [{"message": {"content": ', "}}]}"))
        .otherwise(shaped('{"choices": [{"message": {"content": [{"type": "text", "text": ', "}]}}]}"))
    )
    lines = item.where("k <> 0").select("custom_id", line.alias("line"))
    return ingest.batch_answers(item.drop("_said"), lines)


@query(f"""WITH {_BATCH} SELECT k, count(*) AS n, sum(CASE WHEN {_PRED} = answer THEN 1 ELSE 0 END)::BIGINT AS n_correct, count({_PRED}) AS n_pred,
       sum(CASE k WHEN 0 THEN length('Error: no result returned for this request.') WHEN 1 THEN length('Batch error (busy): no error message provided')
           ELSE length('Think. The answer is (X)') END)::BIGINT AS n_text FROM item GROUP BY 1""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _batch(spark, sf_dir)
    return answers.groupBy("k").agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("n_correct"), F.count("pred").alias("n_pred"),
        F.sum(F.length("model_output")).alias("n_text"),
    )


@query(f"""WITH {_BATCH}, c AS (SELECT run, category, CASE WHEN {_PRED} = answer THEN 1 ELSE 0 END AS r FROM item)
SELECT run, CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, sum(r)::BIGINT AS corr, (count(*) - sum(r))::BIGINT AS wrong,
       sum(r)::DOUBLE / count(*) AS acc FROM c GROUP BY GROUPING SETS ((run, category), (run))""")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by category and in total for every repeated run."""
    return ingest.category_accuracy(_batch(spark, sf_dir), "run")


@query("""SELECT o_orderkey AS question_id, o_orderpriority AS question FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)""")
def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question"), "o_custkey")
    done = items.where("question_id % 3 = 0 and o_custkey % 2 = 0")
    return ingest.unanswered(items, done).select("question_id", "question")


#: Degrees of freedom, and 97.5 % points of Student's t as tables print them.
_POINTS = [(0, None), (1, 12.7062), (2, 4.3027), (3, 3.1824), (5, 2.5706), (10, 2.2281), (30, 2.0423), (60, 2.0003), (61, 1.9996), (120, 1.9799)]


@query(f"SELECT p_partkey AS k, {_sql_pick('p_size', [d for d, _ in _POINTS])}::INT AS d, ({_sql_pick('p_size', [t for _, t in _POINTS])})::DOUBLE AS t FROM part")
def t_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """97.5 % points of Student's t for degrees of freedom by part size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _pick(F.col("p_size"), [d for d, _ in _POINTS]).alias("d"))
    return rows.withColumn("t", F.round(t_quantile(F.col("d")), 4))


_WORDS = [("1", 1), ("correct", 1), (" TRUE ", 1), ("t", 1), ("Yes", 1), ("y", 1), ("1.0", 1), ("0", 0), ("no", 0), ("right", 0), (None, 0)]


@query(f"WITH {_LINE} SELECT o, n, {_sql_pick('o + n', [c for _, c in _WORDS])}::INT AS correct FROM line")
def correct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for right and wrong, of order lines."""
    return _lines(spark, sf_dir).select("o", "n", X.correctness(_pick(F.col("o") + F.col("n"), [w for w, _ in _WORDS])).alias("correct"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%dT%H%M%S') || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || 'Z_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '_', 'g')
    || '_seed' || o_custkey AS quiz_id FROM orders""")
def quiz_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of runs at the orders' dates and some milliseconds."""
    made = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 1000) / F.lit(1000).cast("decimal(8,3)"))
    name = X.quiz_id(made, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), name.alias("quiz_id"))


_PATHS = [("/x<k>/eval/runs/g/<k>", "/new/eval/runs/g/<k>"), ("C:\\x\\eval\\runs\\<k>", "/new/eval/runs/<k>"), ("/x/eval/<k>", "/new/eval/<k>"), ("/other/<k>", None)]


@query(f"SELECT o_orderkey AS k, {_sql_filled(_sql_pick('o_orderkey', [p for _, p in _PATHS]), k='o_orderkey::VARCHAR')} AS localized FROM orders")
def localized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths recorded elsewhere, of every order."""
    path = _filled(_pick(F.col("o_orderkey"), [p for p, _ in _PATHS]), k=F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), X.localized(path, "/new/", "eval/runs", "eval/").alias("localized"))
