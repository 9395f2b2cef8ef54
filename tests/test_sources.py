"""Readers of evaluation trees on small files with the awkward cases."""

import json

import pytest
from pyspark.sql import functions as F

from veridict.operators import accuracy, validity
from veridict.sources import json_tree as J
from veridict.sources import sinks


@pytest.fixture()
def tree(tmp_path):
    def put(path, value):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(value if isinstance(value, str) else json.dumps(value))

    def rating(q, **k):
        return {"quiz_id": "q1", "question_id": q, "judge_output_valid": True, "judge_verdict": "PASS", "judge_medical_accuracy_score": 4} | k

    put("gen1/q1_seed3/ja_judge_result.json", [
        rating("a"), rating("b", judge_verdict=" fail "), rating("c", judge_medical_accuracy_score="4"), rating("d", judge_medical_accuracy_score=3.7),
        rating("e", judge_medical_accuracy_score="3.0"), rating("f", judge_verdict="MAYBE", judge_json={"logical_validity": True}), rating("g", judge_output_valid=None),
    ])
    put("gen1/q1_seed3/jb_judge_result.json", [rating("a"), rating("b"), rating("d", judge_output_valid=False)])
    put("gen1/q1_seed3/bad_judge_result.json", "not json")
    answers = [
        {"quiz_id": "q1", "question_id": "a", "answer": " A", "pred": "A", "target_topic": "x"},
        {"quiz_id": "q1", "question_id": "b", "answer": "B", "pred": None, "topic": "y"},
        {"quiz_id": "q1", "question_id": "c", "answer": "C", "pred": "C "}, {"quiz_id": "q1", "question_id": "z", "answer": "", "pred": "C"},
    ]
    put("gen1/q1_seed3/m1_result.json", answers)
    put("gen2/q2_seed4/m1_result.json", [{"quiz_id": "q2", "question_id": "a", "answer": "A", "pred": "B"}])
    put("gen1/q1_seed3/m1_summary.json", {"model": "m1", "total_corr": 2, "total_wrong": 2, "acc": 0.5, "n_items": 4})
    put("gen2/q2_seed4/m1_summary.json", {"model": "m1", "total_corr": 1, "total_wrong": 1, "acc": 0.9, "n_items": 2})
    put("gen1/q1_seed3/ja_judge_summary.json", {"model": "ja", "quiz_id": "q1", "n_items": 9, "fail_reason_counts": {"C": 1}})
    put("gen2/q2_seed4/summary_all_judges.json", [{"model": "jz", "quiz_id": "q2", "n_items": 3}])
    put("gen1/q1_seed3/topics_ev.json", {"quiz_id": "q1", "eval_model": "ev", "per_question": [{"question_id": "a", "topic": "Raw  One"}, {"topic": None}]})
    put("gen1/q1_seed3/topics_ev_mapped.json", {
        "quiz_id": "q1", "eval_model": "ev", "topic_mapping": {"applied_at": "2026"}, "per_question": [{"question_id": "a", "topic": "Raw", "topic_mapped": "Mapped"}],
    })
    put("m/quizbench_manifest_1.json", {"generator_model": "g1", "quizzes": [{"quiz_id": "q1", "seed": 3}, {"quiz_id": "q_seed9"}]})
    put("m/quizbench_manifest_2.json", {"generator_model": "g2", "quizzes": [{"quiz_id": "q1", "quiz_path": "p", "target_topic": ["t"]}]})
    put("quizzes/q1.jsonl", '{"quiz_id": "q1", "target_topic": "x"}\n\n{"quiz_id": "q1"}\n')
    return str(tmp_path)


def test_ratings_and_filters(spark, tree):
    r = J.read_ratings(spark, tree)
    got = {(x.judge, x.unit): (x.verdict, x.score, x.output_valid) for x in r.collect()}
    assert got[("ja", "b")] == ("FAIL", 4, True) and got[("ja", "c")][1] == 4 and got[("ja", "d")][1] == 3
    assert got[("ja", "e")][1] is None and got[("ja", "f")][0] == "PASS" and len(got) == 10
    units = lambda **k: {x.unit for x in validity.accepted_units(r, **k).collect()}
    assert units(min_score=3) == {"a", "c", "d", "f"}  # b ties one to one; e has no score; g is not known to be valid
    assert units(min_score=3, mode="all") == {"a"}
    assert units(min_score=3, mode="score") == {"a", "b"}


def test_unrated_runs_are_not_filtered(spark, tree):
    answers, r = J.read_answers(spark, tree), J.read_ratings(spark, tree)
    kept = {(x.generator, x.unit) for x in validity.keep_accepted(answers, r, min_score=5).collect()}
    assert kept == {("gen2", "a")}  # nothing reaches 5 in the rated run; the other has no judges
    runs = {(x.generator, x.model): (x.acc, x.n_items) for x in accuracy.run_accuracy(answers).collect()}
    assert runs[("gen1", "m1")] == (pytest.approx(1 / 3), 3)  # null pred left out, gold stripped, pred not
    assert {(x.question_id, x.correct) for x in J.item_level(answers).where("quiz_id = 'q1'").collect()} == {("a", 0), ("b", 0), ("c", 0)}


def test_summaries_and_missing_work(spark, tree):
    s = J.read_answer_summaries(spark, tree)
    s = s.where("model is not null and total_corr is not null")
    assert {x.run for x in J.consistent_summaries(s).collect()} == {"q1_seed3"}
    quizzes = spark.createDataFrame([("q1_seed3", 4), ("q2_seed4", 2), ("new", None)], "quiz_id string, n_items long")
    assert {x.quiz_id for x in J.missing_work(quizzes, s, "m1").collect()} == {"q2_seed4", "new"}
    assert {x.model for x in J.read_judge_summaries(spark, tree).collect()} == {"ja", "jz"}
    assert J.partial_runs(J.read_answers(spark, tree), s).count() == 0


def test_manifests(spark, tree):
    q = J.read_manifest_quizzes(spark, f"{tree}/m")
    assert {x.quiz_id: x.seed for x in q.collect()}["q_seed9"] == 9
    by_path = {x.quiz_id: (x.generator, x.conflict) for x in J.quiz_generators(q).collect()}
    assert by_path == {"q1": ("g1", True), "q_seed9": ("g1", False)}
    merged = {x.quiz_id: x for x in J.merge_manifests(q).collect()}
    assert (merged["q1"].quiz_path, merged["q1"].seed, merged["q1"].generator) == ("p", 3, "g2")


def test_topics(spark, tree):
    t = J.read_topics(spark, tree)
    assert {x.question_id for x in t.where("topic = 'unknown'").collect()} == {"q1-002"}
    assert {(x.question_id, x.topic) for x in J.question_topics(J.choose_topics(t, "ev")).collect()} == {("a", "mapped")}
    for policy in ("subset", "planner", "accumulate"):
        assert {x.file_name for x in J.choose_topics(t, "ev", policy).collect()} == {"topics_ev_mapped.json"}


def test_lines_and_tables(spark, tree, tmp_path):
    assert [x.n for x in J.count_quiz_lines(spark, f"{tree}/quizzes").collect()] == [2]
    lines = J.target_topics(spark, f"{tree}/quizzes").orderBy("line").collect()
    assert [(x.line, x.target_topic) for x in lines] == [(0, "x"), (1, None)]
    (tmp_path / "t.csv").write_text("﻿Specialty,Number\nB,2\nA,0\n")
    assert [(x.category, x.target, x.ord) for x in J.read_targets(spark, str(tmp_path / "t.csv")).orderBy("ord").collect()] == [("B", 2, 0), ("A", 0, 1)]
    (tmp_path / "u.csv").write_text("Specialty,Number\nB,2\nB,1\n")
    with pytest.raises(ValueError, match="unusable"):
        J.read_targets(spark, str(tmp_path / "u.csv"))
    (tmp_path / "c.csv").write_text("﻿model,cost_per_quiz\na,1.5\nb,x\na,2.5\n")
    assert [(x.model, x.cost) for x in J.read_cost(spark, str(tmp_path / "c.csv")).collect()] == [("a", 2.5)]
    (tmp_path / "v.csv").write_text("model,questions_passing_percent\na,95\nb,0.5\nc,\n")
    assert {x.model: x.validity for x in J.read_validity(spark, str(tmp_path / "v.csv")).collect()} == {"a": 0.95, "b": 0.5, "c": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "A", 1, 0), ("g", "B", 2, 1), ("h", "A", 3, 0)], "generator string, category string, question_id long, index int")
    report = {x.generator_model: x for x in sinks.selection_report(df, "tag").collect()}
    assert report["g"].targets_by_specialty == {"A": 1, "B": 1} and [s.question_id for s in report["g"].selected] == [1, 2]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_by_key(df, str(tmp_path / "k"), "generator")
    assert spark.read.json(str(tmp_path / "k")).count() == 3
    sinks.write_csv(df, str(tmp_path / "c"), ["question_id", "generator"], one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["question_id", "generator"]
    requests = sinks.batch_requests(df.select(F.lit("id").alias("custom_id"), F.lit("p").alias("prompt")), "m")
    assert json.loads(requests.first().value)["body"] == {"model": "m", "input": "p"}


def test_versions_missing_and_stored(spark, tmp_path):
    df = spark.createDataFrame([("g", "A", 1, 0), ("h", "B", 2, 1)], "generator string, category string, question_id long, index int")
    assert {(r.generator, r.n) for r in sinks.write_versions(df, str(tmp_path / "v"), "1", "generator", dry_run=True).collect()} == {("g", 1), ("h", 1)}
    assert not (tmp_path / "v").exists()
    sinks.write_versions(df, str(tmp_path / "v"), "1", "generator")
    sinks.write_versions(df.limit(1), str(tmp_path / "v"), "2", "generator")
    assert spark.read.json(str(tmp_path / "v" / "1")).count() == 2
    first = sinks.write_missing(df.where("generator = 'g'"), str(tmp_path / "m"), "generator")
    again = sinks.write_missing(df, str(tmp_path / "m"), "generator")
    assert [r.generator for r in first.collect()] == ["g"] and [r.generator for r in again.collect()] == ["h"]
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    from veridict.operators import subset

    chunked = subset.chunk(df, 1)
    sinks.write_subset(chunked, str(tmp_path / "s"), "tag")
    assert {(r.generator, r.n_items, r.first_id) for r in spark.read.json(str(tmp_path / "s/manifest")).collect()} == {("g", 1, "part-p00-001"), ("h", 1, "part-p01-001")}
    assert sinks.stale_reasons({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b differs (2 != 3)"]
    calls = []

    def compute():
        calls.append(1)
        return df

    for wanted in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.stored_or_computed(spark, str(tmp_path / "c"), wanted, compute).count() == 2
    assert len(calls) == 2


def test_configuration():
    from veridict.sources import config

    assert config.parse_names(" a, b,", "x") == ["a", "b"] == config.parse_names(["a", " b", "", 3], "x") and config.parse_names(None, "x") == []
    for bad in (7, None, " ,"):
        with pytest.raises(ValueError):
            config.parse_names(bad, "x", required=True)
    assert config.whole_number({"n": "3"}, "n", 1) == 3 and config.whole_number({}, "n", 1) == 1
    with pytest.raises(ValueError, match="whole number"):
        config.whole_number({"n": "x"}, "n", 1)
    assert config.parse_topics("a, b\nc") == ["a", "b\nc"] and config.parse_topics("a\n\n b ") == ["a", "b"]
    with pytest.raises(ValueError):
        config.parse_topics(" \n")
    config.check_keys({"a": 1}, ("a",))
    with pytest.raises(ValueError, match="b"):
        config.check_keys({"a": 1}, ("a", "b"))


def test_topic_maps_and_name_lists(tmp_path):
    from veridict.sources import config

    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    short = config.read_topic_map(file("a.json", '{"map": {" Small ": " B ", "x": "", "": "y"}}'))
    assert short == config.TopicMap({"Small": "B"}, ["unknown"], "Misc", True, True)
    full = '{"map": {"a": "b"}, "drop": ["u", ""], "misc_category": " Other ", "combined_to_misc": false, "normalize": false}'
    assert config.read_topic_map(file("b.json", full)) == config.TopicMap({"a": "b"}, ["u"], "Other", False, False)
    for name, text in (("c.json", "[1]"), ("d.json", '{"map": [1]}'), ("e.txt", "{}")):
        with pytest.raises(ValueError):
            config.read_topic_map(file(name, text))
    pytest.importorskip("yaml")
    yaml = config.read_topic_map(file("f.yaml", "map:\n  Small parts: 'B'\n  7: C\ndrop:\n  - u\nmisc_category: M\n"))
    assert yaml == config.TopicMap({"Small parts": "B", "7": "C"}, ["u"], "M", True, True)
    assert config.read_topic_map(file("g.yml", "")) == config.TopicMap({}, ["unknown"], "Misc", True, True)
    assert config.read_names(file("h.yaml", "# list\n- a\n - 'b c'  # note\n\n-\n- \"a\"\n- a\n")) == ["a", "b c"]
    with pytest.raises(ValueError, match="items of a list"):
        config.read_names(file("i.yaml", "names:\n- a\n"))


@pytest.mark.parametrize("text", ["valid,total\n1,2\n", "generator,valid,total\n,1,2\n", "generator,valid,total\na,3,2\n", "generator,valid,total\na,1,0\n", "generator,valid,total\na,x,2\n", "generator,valid,total\n_Example,1,2\n"])
def test_counts_that_are_none(spark, tmp_path, text):
    (tmp_path / "c.csv").write_text(text)
    with pytest.raises(ValueError):
        J.read_counts(spark, str(tmp_path / "c.csv"))


def test_batches_that_are_none(spark):
    from veridict.operators import scopes

    runs = spark.createDataFrame([("q1",), ("q2",)], "run string")
    quizzes = spark.createDataFrame([("q1", "quizbench_manifest_T.json"), ("q9", "quizbench_manifest_S.json")], "quiz_id string, file_name string")
    assert [r.run for r in scopes.of_batch(runs, quizzes, "T").collect()] == ["q1"]
    with pytest.raises(ValueError, match="no manifests"):
        scopes.of_batch(runs, quizzes, "U")
    with pytest.raises(ValueError, match="no runs"):
        scopes.of_batch(runs, quizzes, "S")


def test_overrides_of_overrides(spark):

    from veridict.operators import topics

    rows = spark.createDataFrame([(" ab & C",), ("small",), ("lost",), ("x",), (None,), ("B",)], "t string")
    got = {r.t: tuple(r.c) for r in rows.select("t", topics.canonical(F.col("t"), ["AB and c", "B"], {"Small": "b", "lost": "nowhere", "b": "AB and c"}).alias("c")).collect()}
    assert got == {" ab & C": ("AB and c", None), "small": ("B", None), "lost": (None, "no category: nowhere"), "x": (None, "no category: x"), None: (None, "no category: "), "B": ("B", None)}
