"""Topics with reasons, diagnostics, audits, samples, ages, and places of JSON errors."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veridict.functions.json_scan import json_error
from veridict.functions.text import jittered_ages
from veridict.operators import planning as P


def test_sources_of_topics(spark):
    runs = spark.createDataFrame([(f"r{k}",) for k in range(7)], "run string")
    files = [
        ("r0", "a", "x", None), ("r0", "a", "y", None), ("r0", "b", None, None), ("r0", " ", "z", None), ("r1", None, None, "unknown_error"), ("r1", "a", "x", None),
        ("r2", "a", None, None), ("r3", " c ", "x", None),
    ]
    quiz = [("r0", 0, "q", "never"), ("r2", 0, "q", "never"), ("r4", 0, None, "t"), ("r4", 11, "  ", "u"), ("r4", 2, "id", None), ("r5", 0, "q", None)]
    labelled = spark.createDataFrame(files, "run string, question_id string, topic string, error string")
    lines = spark.createDataFrame(quiz, "run string, line int, question_id string, topic string")
    got = {tuple(r) for r in P.sourced_topics(runs, labelled, lines).collect()}
    assert got == {
        ("r0", "a", "y", "topics", None), ("r1", None, None, "topics", "unknown_error"), ("r2", None, None, "topics", "no_topics_rows"), ("r3", "c", "x", "topics", None),
        ("r4", "r4-001", "t", "quiz", None), ("r4", "r4-012", "u", "quiz", None), ("r5", None, None, "quiz", "no_topics_found_in_quiz_jsonl"),
        ("r6", None, None, "quiz", "no_topics_files_and_missing_quiz_jsonl"),
    }
    strict = {r.run: r.error for r in P.sourced_topics(runs, labelled, lines, fallback=False).collect() if r.error}
    assert strict == {"r1": "unknown_error", "r2": "no_topics_rows"} | {f"r{k}": "no_topics_files" for k in (4, 5, 6)}


def test_targets_without_a_valid_question(spark):
    questions = spark.createDataFrame([("r", 1, "A"), ("r", 2, "A"), ("r", 3, "A"), ("r", 4, "B"), ("s", 5, "A"), ("t", 6, "A"), ("u", 7, "A"), ("r", 8, "C")], "run string, unit int, topic string")
    ratings = [
        ("r", 1, "j", True, "PASS", 5), ("r", 1, "k", True, "FAIL", 5), ("r", 1, "k", True, "FAIL", 5), ("r", 2, "j", False, "PASS", 5), ("r", 2, "k", True, "PASS", 1), ("r", 3, "j", True, None, 5),
        ("r", 4, "j", True, " pass ", 5), ("r", 8, "j", None, "PASS", 5),
    ]
    votes = spark.createDataFrame(ratings, "run string, unit int, judge string, output_valid boolean, verdict string, score int")
    runs = spark.createDataFrame([("r", None), ("s", "no_topics_rows"), ("u", None)], "run string, reason string")
    targets = spark.createDataFrame([("A",), ("B",), ("D",)], "category string")
    got = {tuple(r) for r in P.zero_valid_targets(targets, questions, votes, runs, judges=3, min_score=2).collect()}
    assert got == {
        ("A", "included", "majority_fail", 2), ("A", "included", "no_eligible_judges", 1), ("A", "included", "no_judge_results_found", 1), ("A", "skipped", "no_topics_rows", 1),
        ("A", "skipped", "untracked_run", 1), ("A", "pass/eligible", "1/2", 1), ("A", "pass/eligible", "0/1", 1), ("A", "verdicts", "PASS", 1), ("A", "verdicts", "FAIL", 1),
        ("A", "verdicts", "other", 1), ("A", "ineligible", "missing_result", 1), ("A", "ineligible", "invalid_output", 1), ("A", "ineligible", "below_min_medical_score", 1),
        ("D", "included", "none", 0),
    }
    lenient = P.zero_valid_targets(targets, questions, votes, runs, 3, 2, allow_missing=True)
    assert {r.category for r in lenient.collect()} == {"D"}


def test_audits_add_up(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", None), (4, "a", 1), (5, None, None)], "unit int, verdict string, score int")
    got = P.audit(rows, {"no_verdict": F.col("verdict").isNotNull(), "low": F.col("score") > 2}).first().asDict()
    assert got == {"total": 5, "no_verdict": 2, "low": 2, "passed": 1}
    votes = [(1, j, v, s) for j, v, s in (("a", "PASS", 1), ("b", "PASS", 2), ("c", "FAIL", None))] + [(2, "a", None, 3), (3, "a", "PASS", 3), (4, "a", "FAIL", 1), (4, "b", "FAIL", 1), (5, "a", "PASS", None)]
    got = P.score_audit(spark.createDataFrame(votes, "unit int, judge string, verdict string, score int"), min_pass=2, min_total=2).first().asDict()
    assert got == {"total": 4, "missing_logical": 1, "insufficient_logical": 1, "failed_pass": 1, "passed": 1}


def test_samples_of_topics(spark):
    topics = [f" t{k}" for k in range(40)] + ["", "t1 "]
    rows = spark.createDataFrame([(1, 4, topics), (1, 4, topics[::-1]), (2, 4, topics), (3, 60, topics), (4, 60, ["a", " "]), (5, 2, None)], "seed int, n int, topics array<string>")
    one, same, other, many, few, none = (r.sampled for r in P.sampled_topics(rows).collect())
    assert one == same and len(one) == 5 and set(one) <= {f"t{k}" for k in range(40)}
    assert other != one and len(many) == 30 and len(set(many)) == 30 and few == ["a"] and none == []


@pytest.mark.parametrize("plan,counts,n,problem", [
    (["a", "b", " a"], {"a": 2, "b": 1}, 3, None), (["a"], None, 2, "topic_plan length != num_questions"), ([], {"a": 1}, 2, "topic_counts sum != num_questions"),
    (["a", "b"], {"a": 2}, 2, "topic_counts mismatch topic_plan"), (None, {"a": 2, "x": 0, " ": 5}, 2, None), (None, None, 7, None),
])
def test_plans(spark, plan, counts, n, problem):
    row = spark.createDataFrame([(plan, counts, n)], "plan array<string>, counts map<string,int>, n int")
    assert row.select(P.plan_problem(F.col("plan"), F.col("counts"), F.col("n")).alias("p")).first().p == problem


def test_ages(spark):
    texts = ["A 45-year-old man and 7 yo, 007year old; 12 years", "yo 1yo", "45 Year-Old", "none", "", None, "year-old 3 - yo 3\tyo" + " 9yo" * 300]
    got = {r.t: r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", jittered_ages(F.col("t"), F.lit("k")).alias("j")).collect()}
    for t, j in got.items():
        if t is None:
            assert j is None
            continue
        ages = re.findall(r"(?i)\b(\d+)(?:\s*[-\s]?)(?:year-old|year old|yo)\b", t)
        found = re.findall(r"(\d+)\.(0[0-4]\d) year-old", j)
        assert [int(a) for a in ages] == [int(a) for a, _ in found] and all(int(d) <= 40 for _, d in found)
        assert re.sub(r"\d+\.0[0-4]\d year-old", "#", j) == re.sub(r"(?i)\b(\d+)(?:\s*[-\s]?)(?:year-old|year old|yo)\b", "#", t)
    added = [int(d) for d in re.findall(r"\d+\.(\d{3}) year-old", got[texts[-1]])]
    assert 17 < sum(added) / len(added) < 23 and len(set(added)) > 30


def parser(text):
    """Place and message of Python's parser; of a comma too many, what should have followed it."""
    try:
        json.loads(text)
    except json.JSONDecodeError as e:
        if e.msg.startswith("Illegal trailing comma"):
            pos = next(i for i in range(e.pos + 1, len(text)) if text[i] not in " \t\n\r")
            line = text.count("\n", 0, pos) + 1
            return pos, line, pos - (text.rfind("\n", 0, pos) if line > 1 else -1), "Expecting value" if "array" in e.msg else "Expecting property name enclosed in double quotes"
        return e.pos, e.lineno, e.colno, e.msg


def test_json_errors_are_those_of_a_parser(spark):
    rng = random.Random(3)

    def value(depth):
        r = rng.random()
        if depth > 2 or r < 0.35:
            return rng.choice([1, -2.5, 1e9, True, None, 'a"b\\c\ndé', "", "x y", 0])
        return [value(depth + 1) for _ in range(rng.randint(0, 3))] if r < 0.65 else {rng.choice("abcdé"): value(depth + 1) for _ in range(rng.randint(0, 3))}

    texts = ["", "  ", "01", "1.", "-", "tru", "nul", '"a', '{"a"', '{"a":', '{"a":1', '{"a":1,', '{"a":1,}', "[1,]", "[1", "[", "{", "{a:1}", '"\\x"', '"\\u12g4"', '"\\u1234"',
             '"a\x01b"', "1 2", "{}x", "[1 2]", '{"a" 1}', '"\\', '"\\u12', "NaN", "-Infinity", "1e5", "1e", '{"a":"b\nc"}', "]", '{"a":1]', '"ab\\"']
    for _ in range(400):
        t, k = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), rng.random()
        i = rng.randrange(len(t) + 1)
        texts.append(t[:i] + t[i + 1 :] if k < 0.3 else t[:i] + rng.choice('{}[],:"\\x1 \n\x02') + t[i:] if k < 0.6 else t[:i] if k < 0.75 else t)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).withColumn("e", json_error(F.col("t"))).collect()
    for r in got:
        assert (tuple(r.e) if r.e else None) == parser(r.t), r.t
    assert spark.createDataFrame([(None,)], "t string").select(json_error(F.col("t")).alias("e")).first().e is None


def test_topics_of_a_brand_are_gathered_once(spark):
    """A request meets the different types of its brand, not one for every part: these grow with the tables, and so do the requests."""
    from veridict.plans import planning as plans

    plan = plans.sampled_topics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "collect_list" not in plan
