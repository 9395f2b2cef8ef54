"""Summaries that arrive between two runs, and driver-side configuration."""

import json

from veridict.sources.config import read_names, read_topic_map
from veridict.streaming import summaries


def put(root, run, model, acc):
    folder = root / "gen" / run
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{model}_summary.json").write_text(json.dumps({"model": model, "acc": acc, "n_items": 10}))
    (folder / "j_judge_summary.json").write_text(json.dumps({"model": "j"}))


def test_running_accuracy(spark, tmp_path):
    root, out, state = tmp_path / "runs", str(tmp_path / "out"), str(tmp_path / "state")
    put(root, "q1", "m", 0.5)
    put(root, "q1", "n", None)

    def step():
        summaries.write_available(summaries.running_accuracy(summaries.answer_summary_stream(spark, str(root))), out, state)
        return {r.model: (r.mean_acc, r.n_quizzes) for r in spark.read.parquet(out).collect()}

    assert step() == {"m": (0.5, 1), "n": (0.0, 1)}
    put(root, "q2", "m", 1.0)
    assert step() == {"m": (0.75, 2), "n": (0.0, 1)}


def test_config(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"map": {"a": "B"}, "drop": ["x"], "misc_category": "M", "combined_to_misc": True}))
    found = read_topic_map(str(tmp_path / "m.json"))
    assert (found.overrides, found.drop, found.misc, found.combined_to_misc) == ({"a": "B"}, ["x"], "M", True)
    (tmp_path / "n.yaml").write_text("models:\n- a # first\n- 'b'\n- a\n")
    assert read_names(str(tmp_path / "n.yaml")) == ["a", "b"]
