"""Readers of evaluation trees over a small tree with the awkward cases; results are stated by hand."""

import json

import pytest
from pyspark.sql import functions as F

from veridict.sources import json_tree as J


def _rating(unit: str, **more) -> dict:
    return {"quiz_id": "q1", "question_id": unit, "judge_output_valid": True, "judge_verdict": "PASS", "judge_medical_accuracy_score": 4} | more


_ITEM = {"quiz_id": "q1", "answer": "A"}
#: Files of the tree, in the order in which they are written.
FILES = {
    "gen1/q1_seed3/ja_judge_result.json": [
        _rating("a"), _rating("b", judge_verdict=" fail "), _rating("c", judge_medical_accuracy_score="4"), _rating("d", judge_medical_accuracy_score=3.7),
        _rating("e", judge_medical_accuracy_score="3.0"), _rating("f", judge_verdict="MAYBE", judge_json={"logical_validity": True}),
    ],
    "gen1/q1_seed3/bad_judge_result.json": "not json",
    "gen1/q1_seed3/m1_result.json": [
        _ITEM | {"question_id": "a", "answer": " A", "pred": "A", "target_topic": "x"}, _ITEM | {"question_id": "b", "pred": None, "topic": "y"},
        _ITEM | {"question_id": "", "pred": "A"}, _ITEM | {"question_id": "z", "answer": "", "pred": "C"},
    ],
    "gen2/q2_seed4/m2_result.json": [{"quiz_id": "q2", "question_id": "a", "answer": "A", "pred": "A"}],
    "gen1/q1_seed3/m1_summary.json": {"model": "m1", "total_corr": 2, "total_wrong": 2, "acc": 0.5, "n_items": 4},
    "gen2/q2_seed4/m1_summary.json": {"model": "m1", "total_corr": 1, "total_wrong": 1, "acc": 0.9, "n_items": 2},
    "gen2/q2_seed4/manifest.json": {"n_items": 7},
    "gen1/q1_seed3/ja_judge_summary.json": {"model": "ja", "quiz_id": "q1", "n_items": 9, "fail_reason_counts": {"C": 1}},
    "gen2/q2_seed4/summary_all_judges.json": [{"model": "jz", "quiz_id": "q2", "n_items": 3}],
    "gen3/other/summary_all_judges.json": [{"model": "jz", "quiz_id": "q3", "n_items": 5}, {"model": "jy", "quiz_id": "q3", "n_items": 6}],
    "gen1/q1_seed3/topics_ev.json": {"quiz_id": "q1", "eval_model": "ev", "per_question": [{"question_id": "a", "topic": "Raw  One"}, {"topic": None}]},
    "gen1/q1_seed3/topics_ev_mapped.json": {
        "quiz_id": "q1", "eval_model": "ev", "topic_mapping": {"applied_at": "2026"}, "per_question": [{"question_id": "a", "topic": "Raw", "topic_mapped": "Mapped"}],
    },
    "gen2/q2_seed4/topics_a.json": {"quiz_id": "q2", "eval_model": "ev", "per_question": [{"question_id": "a", "topic": "s"}]},
    "gen2/q2_seed4/topics_b.json": {"quiz_id": "q2", "eval_model": "ev", "per_question": [{"question_id": "a", "topic": "t"}]},
    "gen3/other/topics_c.json": {"quiz_id": "q3", "eval_model": "ex", "per_question": [{"question_id": "a", "topic": "u"}]},
    "m/quizbench_manifest_1.json": {"generator_model": "g1", "quizzes": [{"quiz_id": "q1", "seed": 3}, {"quiz_id": "q_seed9"}]},
    "m/quizbench_manifest_2.json": {"generator_model": "g2", "quizzes": [{"quiz_id": "q1", "quiz_path": "p", "target_topic": ["t"]}]},
    "m/x/quizbench_manifest.json": {"generator_model": "g3", "quizzes": [{"quiz_id": "q7"}]},
    "m/x/y/quizbench_manifest.json": {"generator_model": "g4", "quizzes": [{"quiz_id": "q8"}]},
    "quizzes/q1.jsonl": '{"quiz_id": "q1", "question_id": "i1", "target_topic": "x"}\n\n{"quiz_id": "q1", "question_id": "i2"}\n',
    "selection/selection_report_t.json": {"subset_tag": "t", "generator_model": "g1", "judge_models": ["ja"], "selected": [{"index": 0, "abms_specialty": "S", "source_question_id": "a"}]},
    "extra.json": {"results": [{"quiz_generator": "gen1", "model": "m9", "accuracy": 0.5, "n_items": 10}, {"quiz_generator": "gen1", "model": "m8", "accuracy": "none"}]},
    "targets.csv": "﻿Number,Specialty\n2,B\n0,A\n", "cost.csv": "﻿model,cost_per_quiz\na,1.5\nb,x\na,2.5\n",
    "accuracy.csv": "model,mean_accuracy,sem_accuracy,n\nb,0.5,,3\na,0.75,0.1,4\nc,x,,\n",
    "validity.csv": "model,questions_passing_percent\na,95\nb,0.5\nc,\n",
    "log.txt": "[INFO] Questions passing judge filters (tagged manifests: T)\n g x: valid=1 / total=4 (25%)\n TOTAL: valid=1 / total=4 (25%)\n\n g y: valid=1 / total=4 (25%)\n",
    "out.jsonl": '{"custom_id": "1", "v": "out"}\n{"custom_id": "2", "v": "out"}\n{"v": "none"}\n', "err.jsonl": '{"custom_id": "2", "v": "err"}\n',
}

#: (reader, row)
ROWS = [
    ("ratings", "gen1|q1_seed3|ja|a|PASS|4|true"), ("ratings", "gen1|q1_seed3|ja|b|FAIL|4|true"), ("ratings", "gen1|q1_seed3|ja|c|PASS|4|true"),
    ("ratings", "gen1|q1_seed3|ja|d|PASS|3|true"), ("ratings", "gen1|q1_seed3|ja|e|PASS|-|true"), ("ratings", "gen1|q1_seed3|ja|f|PASS|4|true"),
    ("answers", "gen1|m1|a| A|A|x"), ("answers", "gen1|m1|b|A|-|y"), ("answers", "gen1|m1||A|A|-"), ("answers", "gen1|m1|z||C|-"), ("answers", "gen2|m2|a|A|A|-"),
    ("item_level", "m1|q1|a|0"), ("item_level", "m1|q1|b|0"), ("item_level", "m2|q2|a|1"),
    ("answer_summaries", "q1_seed3|m1|2|2|0.5|4"), ("answer_summaries", "q2_seed4|m1|1|1|0.9|2"), ("consistent_summaries", "q1_seed3|m1"),
    ("missing_work", "q2_seed4"), ("missing_work", "new"), ("partial_runs", "q2_seed4|m1|no_result"), ("partial_runs", "q2_seed4|m2|no_summary"),
    ("judge_summaries", "q1_seed3|ja|9|C|1"), ("judge_summaries", "q2_seed4|jz|3|-|-"), ("judge_summaries", "other|jz|5|-|-"), ("judge_summaries", "other|jy|6|-|-"),
    ("run_sizes", "q1_seed3|9"), ("run_sizes", "q2_seed4|7"), ("run_sizes", "other|6"),
    ("run_dirs", "q1_seed3"), ("run_dirs", "q2_seed4"), ("run_dirs_glob", "q2_seed4"), ("run_dirs_any", "q1_seed3"), ("run_dirs_any", "q2_seed4"), ("run_dirs_any", "other"),
    ("run_dirs_seed", "q1_seed3"), ("run_dirs_seed", "q2_seed4"),
    ("manifest_quizzes", "q1|g1|3"), ("manifest_quizzes", "q_seed9|g1|9"), ("manifest_quizzes", "q1|g2|-"), ("manifest_quizzes", "q7|g3|-"), ("manifest_quizzes", "q8|g4|-"),
    ("quiz_generators", "q1|g1|true"), ("quiz_generators", "q_seed9|g1|false"), ("quiz_generators", "q7|g3|false"), ("quiz_generators", "q8|g4|false"),
    ("merged_manifests", "q1|p|g2|3"), ("merged_manifests", "q_seed9|-|g1|9"), ("merged_manifests", "q7|-|g3|-"), ("merged_manifests", "q8|-|g4|-"),
    ("legacy_manifests", "q7"), ("generators_of_newest", "q7|g3"), ("generators_of_newest", "q8|g4"), ("generators_of_newest", "q1|g2"),
    ("topics", "q1_seed3|topics_ev.json|a|Raw  One"), ("topics", "q1_seed3|topics_ev.json|q1-002|unknown"), ("topics", "q1_seed3|topics_ev_mapped.json|a|Raw"),
    ("topics", "q2_seed4|topics_a.json|a|s"), ("topics", "q2_seed4|topics_b.json|a|t"), ("topics", "other|topics_c.json|a|u"), ("topics_listed", "other|topics_c.json|a|u"),
    ("choose_misses", "q1_seed3|topics_ev_mapped.json"), ("choose_misses", "q2_seed4|topics_b.json"), ("choose_misses", "other|topics_c.json"),
    ("choose_subset", "q1_seed3|topics_ev_mapped.json"),
    ("choose_planner", "q1_seed3|topics_ev_mapped.json|-"), ("choose_planner", "q2_seed4|-|several unmapped topics files"),
    ("choose_planner", "other|-|no topics file of the evaluator"),
    ("choose_accumulate", "q1_seed3|topics_ev_mapped.json|-"), ("choose_accumulate", "q2_seed4|-|several topics files"),
    ("choose_accumulate", "other|-|no topics file of the evaluator"),
    ("question_topics", "q1_seed3|a|mapped"), ("question_topics", "q2_seed4|a|t"), ("question_topics", "other|a|u"),
    ("quiz_items", "q1|i1|x"), ("quiz_items", "q1|i2|-"), ("quiz_lines", "q1.jsonl|2"), ("target_topics", "0|x"), ("target_topics", "1|-"),
    ("selection", "t|g1|ja|0|S|a"), ("extra_results", "gen1|m9|0.5|10"), ("batch_lines", "1|out"), ("batch_lines", "2|err"),
    ("targets", "B|2|0"), ("targets", "A|0|1"), ("cost", "a|2.5"), ("accuracy", "a|0.75|0.1|4"), ("accuracy", "b|0.5|-|3"),
    ("validity", "a|0.95"), ("validity", "b|0.5"), ("validity", "c|-"), ("validity_log", "g x|1|4"), ("newest_by_stem", "q1|q1.jsonl"),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, value in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(root)


def test_every_reader(spark, root):
    """Every reader's rows, a text each: fields between bars, a dash for a missing one."""
    name = lambda c: F.regexp_extract(c, "([^/]*)/*$", 1)
    ratings, answers, summaries = J.read_ratings(spark, root), J.read_answers(spark, root), J.read_answer_summaries(spark, root)
    taken = summaries.where("model is not null and total_corr is not null")
    quizzes, topics = J.read_manifest_quizzes(spark, f"{root}/m"), J.read_topics(spark, root)
    work = spark.createDataFrame([("q1_seed3", 4), ("q2_seed4", 2), ("new", None)], "quiz_id string, n_items long")
    lines = lambda file: spark.read.text(f"{root}/{file}")
    run, dirs = name("run_dir"), lambda *a, **k: J.run_dirs(spark, root, *a, **k)
    chosen = lambda policy: J.choose_topics(topics, "ev", policy)
    files = lines("quizzes/q1.jsonl").select("_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified")).distinct()
    found = {
        "ratings": (ratings, ["generator", name("run_id"), "judge", "unit", "verdict", "score", "output_valid"]),
        "answers": (answers, ["generator", "model", "unit", "gold", "pred", "topic"]),
        "item_level": (J.item_level(answers), ["model", "quiz_id", "question_id", "correct"]),
        "answer_summaries": (taken, ["run", "model", "total_corr", "total_wrong", "acc", "n_items"]),
        "consistent_summaries": (J.consistent_summaries(taken), ["run", "model"]), "missing_work": (J.missing_work(work, taken, "m1"), ["quiz_id"]),
        "partial_runs": (J.partial_runs(answers, taken), [run, "model", "state"]),
        "judge_summaries": (J.read_judge_summaries(spark, root), ["run", "model", "n_items", F.map_keys("fail_reason_counts")[0], F.map_values("fail_reason_counts")[0]]),
        "run_sizes": (J.run_sizes(spark, root), [run, "n_items"]), "run_dirs": (dirs(), ["run"]), "run_dirs_glob": (dirs("q2*"), ["run"]),
        "run_dirs_any": (dirs(artifacts=J.ARTIFACTS), ["run"]), "run_dirs_seed": (dirs(artifacts=J.ARTIFACTS, containing="seed"), ["run"]),
        "manifest_quizzes": (quizzes, ["quiz_id", "generator", "seed"]), "quiz_generators": (J.quiz_generators(quizzes), ["quiz_id", "generator", "conflict"]),
        "merged_manifests": (J.merge_manifests(quizzes), ["quiz_id", "quiz_path", "generator", "seed"]),
        "legacy_manifests": (J.legacy_manifests(quizzes, f"{root}/m"), ["quiz_id"]),
        "generators_of_newest": (J.generators_of_newest(quizzes), ["quiz_id", "generator"]),
        "topics": (topics, ["run", "file_name", "question_id", "topic"]),
        "topics_listed": (J.read_topics(spark, root, ("gen3",), ("ex",)), ["run", "file_name", "question_id", "topic"]),
        "choose_misses": (chosen("misses"), ["run", "file_name"]), "choose_subset": (chosen("subset"), ["run", "file_name"]),
        "choose_planner": (chosen("planner"), [run, "file_name", "error"]), "choose_accumulate": (chosen("accumulate"), [run, "file_name", "error"]),
        "question_topics": (J.question_topics(chosen("misses")), [run, "question_id", "topic"]),
        "quiz_items": (J.read_quiz_items(spark, f"{root}/quizzes"), ["quiz_id", "question_id", "target_topic"]),
        "quiz_lines": (J.count_quiz_lines(spark, f"{root}/quizzes"), [name("file_path"), "n"]),
        "target_topics": (J.target_topics(spark, f"{root}/quizzes"), ["line", "target_topic"]),
        "selection": (J.read_selection(spark, root), ["subset_tag", "generator_model", F.col("judge_models")[0], "index", "abms_specialty", "source_question_id"]),
        "extra_results": (J.read_extra_results(spark, f"{root}/extra.json"), ["generator", "model", "acc", "n_items"]),
        "batch_lines": (J.batch_lines(lines("out.jsonl"), lines("err.jsonl")), ["custom_id", F.get_json_object("line", "$.v")]),
        "targets": (J.read_targets(spark, f"{root}/targets.csv"), ["category", "target", "ord"]), "cost": (J.read_cost(spark, f"{root}/cost.csv"), ["model", "cost"]),
        "accuracy": (J.read_accuracy(spark, f"{root}/accuracy.csv"), ["model", "mean_acc", "sem", "n_quizzes"]),
        "validity": (J.read_validity(spark, f"{root}/validity.csv"), ["model", "validity"]),
        "validity_log": (J.validity_from_log(spark, f"{root}/log.txt", "T"), ["generator", "n_valid", "n_total"]),
        "newest_by_stem": (J.newest_by_stem(files), ["stem", name("file_path")]),
    }
    out = None
    for reader, (rows, columns) in found.items():
        text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns]
        one = rows.select(F.lit(reader).alias("reader"), F.concat_ws("|", *text).alias("item"))
        out = one if out is None else out.unionByName(one)
    assert sorted((r.reader, r.item) for r in out.collect()) == sorted(ROWS)


def test_written_by_tasks(spark, tmp_path):
    """The driver neither names nor renames a file of a shared folder; texts, names and times are as given."""
    from pyspark.sql import functions as F

    from veridict.sources import sinks

    rows = spark.range(300).select(F.format_string("g/r%d/f.json", "id").alias("path"), F.format_string('{"é": %d}', "id").alias("value"), (1_700_000_000_000 + F.col("id") * 1000).alias("modified"))
    sinks.write_tree(rows, str(tmp_path / "t"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    for k in (0, 7, 299):
        file = tmp_path / f"t/g/r{k}/f.json"
        assert file.read_text(encoding="utf-8") == f'{{"é": {k}}}\n' and file.stat().st_mtime == 1_700_000_000 + k
    assert sum(1 for _ in (tmp_path / "t").rglob("*") if _.is_file()) == 300


def test_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "g/r").mkdir(parents=True)
    (tmp_path / "g/r/a_judge_result.json").write_text('[{"question_id": "1"}, 7]')
    plan = J.read_ratings(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("from_json") <= 1


def test_scan_is_what_readers_read(spark, root, tmp_path):
    """One pass over all files, listed and read by tasks, has the rows of Spark's reader; readers of JSON files take it as they take a root."""
    odd = {"g 1/r#1/ä b%_summary.json": "{}", "g 1/r#1/_x_summary.json": "{}", "g 1/.h/a_summary.json": "{}", "g 1/k=1/[a]_summary.json": '{"acc": "é"}\n', "top_summary.json": "7", "g 1/r/s/t/u_summary.json": "[]"}
    for path, value in odd.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(value, encoding="utf-8")
    (tmp_path / "g 1/r/raw_summary.json").write_bytes(b'{"model": "\xff"}')
    meta = [F.col(v).alias(k) for k, v in J._META.items()]
    for folder in (str(tmp_path), root):
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        # a line's end at the end of a file, which Spark's reader leaves out, is nothing to JSON
        texts = lambda df: sorted((*r[:3], bytes(r[3]).removesuffix(b"\n")) for r in df.withColumn("value", F.col("value").cast("binary")).collect())
        assert texts(J.scan(spark, folder)) == texts(reader.text(folder).select(*meta, "value"))
    J.scan(spark, root).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    for read in (J.read_ratings, J.read_answers, J.read_answer_summaries, J.read_judge_summaries, J.items_per_run, J.run_sizes, J.read_manifest_quizzes, J.read_topics, J.read_selection):
        rows = lambda at: sorted(r.cast for r in read(spark, at).select(F.to_json(F.struct("*")).alias("cast")).collect())  # noqa: B023, E731
        assert rows(kept) == rows(root) != []
    name = F.regexp_extract("run_dir", "([^/]*)$", 1)
    for more in ({}, {"pattern": "q2*"}, {"artifacts": J.ARTIFACTS, "containing": "seed"}):
        assert sorted(map(tuple, J.run_dirs(spark, kept, **more).select(name, "run").collect())) == sorted(map(tuple, J.run_dirs(spark, root, **more).select(name, "run").collect()))


def test_runs_are_read_once(spark):
    """tree_runs opens no file of its tree and no order line again when its parts are read."""
    from veridict import catalog

    files = catalog.QUERIES["tree_runs"](spark, "/root/testdata/sf0.001").inputFiles()
    assert all(f.endswith(".parquet") and "/tree-" in f for f in files)
