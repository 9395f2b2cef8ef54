"""Scalar rules and parsing of model output over literal inputs, whose results are stated by hand."""

import math

import pytest
from pyspark.sql import functions as F

from veridict.functions import model_output as M
from veridict.functions import text as X
from veridict.operators import ingest, leaderboard, scopes, stats, topics

FUNCTIONS = {
    "answer_letter": X.answer_letter, "answer_letter_of_ten": X.answer_letter_of_ten, "family": X.provider_family,
    "exact": lambda x: X.provider_family(x, "exact"), "file_name": X.safe_file_name, "suffix": X.safe_suffix, "id": X.safe_id,
    "slug": X.model_slug, "custom_id": X.custom_id, "generator_of": lambda x: X.generator_of(x, F.lit("")), "json_block": X.json_block,
    "panel": X.surgical_panel, "short_topic": X.short_topic, "batch_tag": X.batch_tag, "blood_or_cancer": X.blood_or_cancer,
    "options": lambda x: X.repaired_options(x).cast("string"), "body_text": M.body_text,
}
#: (function, input, result)
CASES = [
    ("answer_letter", "The answer is Diabetes", "D"), ("answer_letter", "answer is B, not A", "A"), ("answer_letter", "ANSWER : c", "C"),
    ("answer_letter", "answer=B or C", "C"), ("answer_letter", "I choose (D)  ", "D"), ("answer_letter", "(B) is right, I think", None),
    ("answer_letter", "The answer is (Z). Answer: A", None), ("answer_letter", "none at all", None), ("answer_letter", "So E it is", "E"),
    ("answer_letter", "the  answer\nis ( b )", "B"), ("answer_letter", None, None),
    ("answer_letter_of_ten", "The answer is (J).", "J"), ("answer_letter_of_ten", "Answer:\tD", "D"), ("answer_letter_of_ten", "ANSWER: D", None),
    ("answer_letter_of_ten", "best course of action to perform immediately is [C]", "C"),
    ("answer_letter_of_ten", "The best course of action here would be (E) or (F)", "F"),
    ("answer_letter_of_ten", "an action that is best: (G)", "G"), ("answer_letter_of_ten", "I like B", None),
    ("family", "gpt-5.1", "openai"), ("family", "gpt5", "gpt5"), ("family", "OpenAI-x", "openai"), ("family", "o1-mini", "o1-mini"),
    ("family", "anthropic/claude", "anthropic"), ("family", "claude", "claude"), ("family", "Gemini-3", "gemini"), ("family", "google-g", "gemini"),
    ("family", "grok-4", "grok-4"), ("family", "", "unknown"), ("family", None, "unknown"), ("exact", "gpt-5.1", "gpt-5.1"), ("exact", None, "unknown"),
    ("file_name", " a b/c: ", "a_b_c_"), ("suffix", " .a b_. ", "a_b"), ("suffix", None, ""), ("id", " ?? ", "unknown"), ("id", "x/y", "x_y"),
    ("slug", "-a b-", "a-b"), ("slug", "//", "model"), ("slug", "_a.b_", "_a.b_"),
    ("custom_id", "q 1/é", "q-1--"), ("custom_id", "a" * 64, "a" * 64), ("custom_id", "a" * 65, "a" * 51 + "_635361c48bb9"),
    ("generator_of", "20260101T000000000Z_gpt-5_x_seed3", "gpt-5_x"), ("generator_of", "any_gen_seedling", "gen"),
    ("generator_of", "gen_seed3", "unknown"), ("generator_of", "a__seed1", "unknown"), ("generator_of", "a_b_3", "unknown"),
    ("json_block", "x ```json\n{\"a\": 1}\n``` y {", '{"a": 1}'), ("json_block", "```\nplain\n```", "```\nplain\n```"),
    ("json_block", "a [1] b {2} c", "[1]"), ("json_block", " none ", "none"),
    ("panel", "Orthopedic  SURGERY", "surgical"), ("panel", "Urology", "surgical"), ("panel", "Urology clinic", "medicine"),
    ("panel", "Obstetrics", "surgical"), ("panel", "Orthopedics", "medicine"), ("panel", "Emergency Medicine", "other"),
    ("panel", "Internal medicine", "medicine"), ("panel", "unknown", "medicine"), ("panel", None, "medicine"),
    ("short_topic", " Physical  Medicine and rehabilitation", "PM&R"), ("short_topic", "New  topic", "New topic"), ("short_topic", None, ""),
    ("batch_tag", "a/quizzes_Jan2026/quizzes_x/runs", "x"), ("batch_tag", "a/b", None),
    ("blood_or_cancer", "`Hematology`", "Hematology"), ("blood_or_cancer", "\"oncology\"\nmore", "Medical Oncology"),
    ("blood_or_cancer", "It is medical  oncology, not hematology", "Medical Oncology"), ("blood_or_cancer", "hematology or oncology", None),
    ("options", '[“a”, "N/A", "b"]', "[a, b]"), ("options", "no array", None),
    ("body_text", '{"output_text": "A"}', "A"),
    ("body_text", '{"output_text": " ", "output": [{"type": "message", "content": [{"type": "text", "text": "B"}, {"type": "x", "text": "no"}]}, {"type": "text", "text": "C"}, 7]}', "BC"),
    ("body_text", '{"choices": [{"message": {"content": "D"}}]}', "D"),
    ("body_text", '{"choices": [{"message": {"content": [{"type": "text", "text": "E"}, {"type": "image"}, {"type": "text", "text": "F"}]}}]}', "EF"),
    ("body_text", '{"choices": [{"message": {}}]}', ""), ("body_text", '{"other":1}', '{"other":1}'), ("body_text", '"G"', "G"), ("body_text", "H", "H"),
]


#: (value, low, high, level)
LEVELS = [
    (0.125, 0.0, 1.0, 0), (0.375, 0.0, 1.0, 2), (0.625, 0.0, 1.0, 2), (2.0, 0.0, 1.0, 4), (-1.0, 0.0, 1.0, 0), (0.5, 1.0, 1.0, None), (0.5, 1.0, 0.0, None),
    (None, 0.0, 1.0, None), (0.5, None, 1.0, None), (0.7, 0.0, 1.0, 3),
]


_FINE = '"analysis": "x", "medical_accuracy_score": 4, "logical_validity": true, "logical_false_reason": "T"'
#: (response, error, verdict, fail_reason, score)
JUDGEMENTS = [
    ("{" + _FINE + "}", None, "PASS", "NA", 4),
    ("Here: ```json\n{" + _FINE.replace("true", "false").replace('"T"', '" m "') + "}\n```", None, "FAIL", "M", 4),
    ("{" + _FINE.replace("4", '"5"') + "}", None, "PASS", "NA", 5), ("{" + _FINE.replace("4", "3.9") + "}", None, "PASS", "NA", 3),
    ("no json", "json decode error", None, None, None), ("[1]", "Parsed JSON is not an object", None, None, None),
    ('{"analysis": "x"}', "a required field is missing", None, None, None),
    ("{" + _FINE.replace('"x"', "7") + "}", "analysis must be a string", None, None, None),
    ("{" + _FINE.replace("true", '"true"') + "}", "logical_validity must be a boolean", None, None, None),
    ("{" + _FINE.replace('"T"', '"Q"') + "}", "logical_false_reason must be one of C/N/M/U/K/T", None, None, None),
    ("{" + _FINE.replace('"T"', "null") + "}", "logical_false_reason must be one of C/N/M/U/K/T", None, None, None),
    ("{" + _FINE.replace("4", '"high"') + "}", "medical_accuracy_score must be an integer between 1 and 5", None, None, None),
    ("{" + _FINE.replace("4", "null") + "}", "medical_accuracy_score must be an integer between 1 and 5", None, None, None),
    ("{" + _FINE.replace("4", "6") + "}", "medical_accuracy_score must be between 1 and 5", None, None, None),
    ("{" + _FINE.replace('"T"', '"C"') + "}", "logical_false_reason must be T when logical_validity is true", None, None, None),
    ("{" + _FINE.replace("true", "false") + "}", "logical_false_reason must be C/N/M/U/K when logical_validity is false", None, None, None),
]


_ITEM = '{{"question": "{}", "options": ["A", "B", "C", "D", "E"], "answer": "{}", "explanation": "Because."}}'
_QUIZZES = [
    ("q1", ["cardiology", "neurology"], '{"items": [' + _ITEM.format("Q1", "A") + ", " + _ITEM.format("Q2", "b ") + "]}"),
    ("q2", ["t0", " ", "t2"], "Sure:\n```json\n{“items”: [" + _ITEM.format("Q0", "F") + ", " + _ITEM.format("Q1", "C") + ', {"question": "x"}, ' + _ITEM.format("Q3", "D") + "]}\n```"),
    ("q3", None, "sorry"), ("q4", None, '{"items": [{"question": "Q", "options": ["A"], "answer": "A", "explanation": ""}]}'), ("q5", None, '{"none": 1}'),
]




def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_scalar_rules(spark):
    given = rows(spark, [(k, f, x) for k, (f, x, _) in enumerate(CASES)], "k int, function string, input string")
    result = F.coalesce(*(F.when(F.col("function") == f, rule(F.col("input"))) for f, rule in FUNCTIONS.items()))
    got = {r.k: r.result for r in given.select("k", result.alias("result")).collect()}
    assert [got[k] for k in range(len(CASES))] == [c[2] for c in CASES]


def test_heat_levels(spark):
    given = [(k, *r[:3]) for k, r in enumerate(LEVELS)] + [(len(LEVELS), math.nan, 0.0, 1.0)]
    got = rows(spark, given, "k int, v double, low double, high double").select("k", X.heat_level(F.col("v"), F.col("low"), F.col("high")).alias("level"))
    assert [r.level for r in got.orderBy("k").collect()] == [r[3] for r in LEVELS] + [None]


def test_judgements(spark):
    given = rows(spark, [(k, r[0]) for k, r in enumerate(JUDGEMENTS)], "k int, raw string")
    got = ingest.ratings_of(given).orderBy("k").collect()
    assert [(r.parse_error, r.verdict, r.fail_reason, r.score) for r in got] == [r[1:] for r in JUDGEMENTS]
    assert [r.output_valid for r in got] == [r[1] is None for r in JUDGEMENTS]


def test_booleans(spark):
    given = rows(spark, [("true",), ('"False "',), ('"yes"',), ("1",), ("null",)], "input string")
    got = {r.input: (r.b.value, r.b.error) for r in given.select("input", M.boolean_of(F.col("input")).alias("b")).collect()}
    error = "safety_flag must be a boolean"
    assert got == {"true": (True, None), '"False "': (False, None), '"yes"': (None, error), "1": (None, error), "null": (None, error)}


def test_quizzes(spark):
    responses = rows(spark, _QUIZZES, "quiz_id string, target_topics array<string>, raw string")
    got = {(r.question_id, r.question, r.answer, r.answer_index, len(r.options), r.target_topic) for r in ingest.quiz_items(responses).collect()}
    assert got == {("q1-001", "Q1", "A", 0, 5, "cardiology"), ("q1-002", "Q2", "B", 1, 5, "neurology"), ("q2-001", "Q1", "C", 2, 5, None), ("q2-002", "Q3", "D", 3, 5, None)}
    status = {r.quiz_id: (r.status, r.n_items, r.error) for r in ingest.quiz_status(rows(spark, [(f"q{k}",) for k in range(1, 7)], "quiz_id string"), responses).collect()}
    assert status == {
        "q1": ("ok", 2, None), "q2": ("ok", 2, None), "q3": ("error", 0, "Could not parse JSON for quiz q3"), "q6": ("error", 0, "no result returned"),
        "q4": ("error", 0, "Generator returned zero valid items for q4"), "q5": ("error", 0, "Generator returned zero valid items for q5"),
    }


def test_t_points(spark):
    points = {0: None, 1: 12.7062, 2: 4.3027, 3: 3.1824, 5: 2.5706, 10: 2.2281, 30: 2.0423, 60: 2.0003, 61: 1.9996, 120: 1.9799}
    got = rows(spark, [(d,) for d in points], "d int").select("d", F.round(stats.t_quantile(F.col("d")), 4).alias("t")).collect()
    assert {r.d: r.t for r in got} == points


def test_pairwise_tails(spark):
    """Two-sided tails of the normal distribution as tables print them."""
    points = {0.0: 1.0, 0.5: 0.617075, 1.0: 0.317311, 1.959964: 0.05, 2.575829: 0.01, 3.290527: 0.001}
    got = rows(spark, [(z,) for z in points], "z double").select("z", stats.erfc(F.col("z") / 2**0.5).alias("p")).collect()
    assert all(abs(r.p - points[r.z]) < 1e-6 for r in got)


def test_words_ids_and_paths(spark):
    words = {"1": 1, "correct": 1, " TRUE ": 1, "t": 1, "yes": 1, "y": 1, "1.0": 1, "0": 0, "no": 0, "right": 0, None: 0}
    assert {r.w: r.c for r in rows(spark, [(w,) for w in words], "w string").select("w", X.correctness(F.col("w")).alias("c")).collect()} == words
    made = rows(spark, [("2026-01-02 03:04:05.678", "gpt 5", 3), ("2026-12-31 23:59:59", "a", 0)], "made string, generator string, seed int")
    ids = made.select(X.quiz_id(F.col("made").cast("timestamp"), F.col("generator"), F.col("seed")).alias("i")).collect()
    assert [r.i for r in ids] == ["20260102T030405678Z_gpt_5_seed3", "20261231T235959000Z_a_seed0"]
    paths = {"/x/eval/runs/g/q": "/new/eval/runs/g/q", "C:\\x\\eval\\runs": "/new/eval/runs", "/other": None}
    got = rows(spark, [(p,) for p in paths], "p string").select("p", X.localized(F.col("p"), "/new/", "eval/runs", "eval/").alias("l")).collect()
    assert {r.p: r.l for r in got} == paths


def test_bookkeeping(spark):
    seeds = scopes.next_seed(rows(spark, [("a", 5), ("a", 13), ("b", 2), ("c", None)], "generator string, seed int"), 10).collect()
    assert {tuple(r) for r in seeds} == {("a", 4), ("b", 0), ("c", 0)}
    schema = "quiz_id string, path string, modified int"
    hints = rows(spark, [("q1", "h1", 1), ("q1", "h2", 2), ("q3", "h8", 7), ("q3", "h9", 7)], schema)
    newest = scopes.newest_file(hints, rows(spark, [("q1", "i9", 9), ("q2", "i1", 1)], schema)).collect()
    assert {tuple(r) for r in newest} == {("q1", "h2"), ("q2", "i1"), ("q3", "h9")}
    base = [("a", "m.json", "p1", 1), ("a", "x.json", "p2", 9), ("b", "x.json", "p3", 1), ("b", "y.json", "p4", 1)]
    got = scopes.base_manifest(rows(spark, base, "generator string, file_name string, path string, modified int"), "m.json").collect()
    assert {tuple(r) for r in got} == {("a", "p1"), ("b", "p4")}
    lists = rows(spark, [("a", ["y", "x"], ["s"]), ("a", ["z", "x"], None), ("b", [], ["t", "t"])], "generator string, quizzes array<string>, topics array<string>")
    got = scopes.merged_lists(lists, "generator", "quizzes", "topics").collect()
    assert {(r.generator, *r.quizzes, "|", *r.topics) for r in got} == {("a", "x", "y", "z", "|", "s"), ("b", "|", "t")}


def test_requests_and_plans(spark):
    models = rows(spark, [("claude-x",), ("gpt-5",), ("my-claude-x",)], "model string")
    got = models.select("model", leaderboard.provider(F.col("model"), True).alias("b"), leaderboard.provider(F.col("model"), False).alias("s")).collect()
    assert {tuple(r) for r in got} == {("claude-x", "anthropic", "sequential"), ("gpt-5", "openai", "sequential"), ("my-claude-x", "openai", "sequential")}
    asked = leaderboard.next_request(rows(spark, [("a", 3, 4), ("b", 1, 0), ("c", 0, 2)], "category string, need int, valid int")).collect()
    assert {tuple(r) for r in asked} == {("a", 5, 3, 0), ("b", 2, 0, 1), ("c", 0, 0, 0)}
    plan = rows(spark, [("a",), ("a",), ("b",), ("c",)], "category string")
    errors = leaderboard.plan_errors(plan, rows(spark, [("a", 2), ("b", 2), ("d", 1)], "category string, n long")).collect()
    assert {tuple(r) for r in errors} == {("b", 1, 2), ("c", 1, 0), ("d", 0, 1)}


@pytest.mark.parametrize("topic,response,mapped,after", [
    ("Hematology/Oncology", "Hematology.", "Misc", ("Hematology", "Misc")), ("Hematology & oncology", "both hematology and oncology", "Misc", ("Misc", None)),
    ("Oncology", "Hematology", "Medical Oncology", ("Medical Oncology", None)), ("Hematology and Oncology", "oncology", "Medical Oncology", ("Medical Oncology", None)),
])
def test_refined_topics(spark, topic, response, mapped, after):
    got = topics.refined(rows(spark, [(1, topic, mapped)], "question_id int, topic string, mapped string"), rows(spark, [(1, response)], "question_id int, response string")).first()
    assert (got.mapped, got.mapped_before) == after


def _parses(df) -> int:
    """How often a row's plan parses JSON."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_texts_are_parsed_once(spark):
    """What depends on a parsed text several times holds the parsing once, else its cost multiplies with every step."""
    raw = spark.createDataFrame([("q1", "{}", "A")], "quiz_id string, raw string, answer string").withColumnRenamed("quiz_id", "custom_id")
    lines = raw.select("custom_id", F.col("raw").alias("line"))
    responses = raw.withColumnRenamed("custom_id", "quiz_id")
    assert _parses(ingest.batch_answers(raw.select("custom_id", "answer"), lines)) == 2  # the line and its body
    assert _parses(ingest.ratings_of(responses.select("quiz_id", "raw"))) == 1
    assert _parses(ingest.quiz_items(responses)) == 1
    assert _parses(ingest.quiz_status(responses, responses)) == 1
