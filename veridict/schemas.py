"""Explicit schemas of the evaluation files, as DDL for ``spark.read.schema``."""

from __future__ import annotations

_ITEM = (
    "quiz_id string, question_id string, question string, options array<string>, answer string, answer_index int, "
    "explanation string, generator_model string, seed int, category string, difficulty string, "
    "not_for_clinical_use boolean, target_topic string"
)
_SUBSET = (
    "abms_specialty string, abms_source string, source_label_raw string, source_quiz_id string, "
    "source_question_id string, source_runs_root string, source_run_dir string, source_quiz_path string"
)
_JUDGE_JSON = (
    "struct<analysis:string, medical_accuracy_score:string, logical_validity:boolean, logical_false_reason:string, "
    "verdict:string, fail_reason:string>"
)

ITEM = f"{_ITEM}, {_SUBSET}"
ANSWER = f"{_ITEM}, {_SUBSET}, topic string, pred string, model_outputs string"
ANSWER_SUMMARY = (
    "model string, created_at string, total_corr long, total_wrong long, acc double, n_items long, "
    "batch_input_file string, batch_id string, used_batch_api boolean, batch_provider string, quiz_id string"
)
RATING = (
    f"{_ITEM}, judge_model string, judge_model_outputs_raw string, judge_output_valid boolean, judge_parse_error string, "
    f"judge_json {_JUDGE_JSON}, judge_verdict string, judge_fail_reason string, judge_medical_accuracy_score string, "
    "judge_safety_flag boolean"
)
JUDGE_SUMMARY = (
    "model string, quiz_id string, created_at string, n_items long, n_valid_responses long, n_invalid_responses long, "
    "n_pass long, n_fail long, fail_reason_counts map<string,long>, medical_score_mean double, n_safety_flag_true long, "
    "used_batch_api boolean"
)
TOPICS = (
    "quiz_id string, generator_model string, eval_model string, default_topics array<string>, created_at string, "
    "per_question array<struct<question_id:string, topic:string, raw_response:string, topic_mapped:string>>, "
    "summary struct<topic_counts:map<string,long>, majority_topic:string, num_questions:long, num_unclassified:long>, "
    "topic_mapping struct<applied_at:string, mode:string>"
)
MANIFEST = (
    "generator_model string, num_questions_per_quiz int, chunk_size int, quizzes array<struct<quiz_id:string, "
    "quiz_path:string, generator_model:string, seed:int, target_topic:array<string>>>"
)
SELECTION = (
    "subset_tag string, generator_model string, targets_by_specialty map<string,long>, judge_models array<string>, "
    "selected array<struct<index:int, abms_specialty:string, label_source:string, source_label_raw:string, "
    "source_quiz_id:string, source_question_id:string, source_run_dir:string>>"
)
EXTRA_RESULTS = (
    "results array<struct<quiz_generator:string, model:string, accuracy:string, n_items:string>>"
)
