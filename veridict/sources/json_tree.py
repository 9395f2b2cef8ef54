"""Readers of evaluation trees ``<root>/<generator>/<run>/<file>.json``.

Everything is one scan of many small files with an explicit schema: the file's
path is data (generator, run, model), and no file is opened on the driver.
Files that are not JSON are dropped; of an array, only what is no object.

Where several readers go over one large tree, ``scan`` reads its files once;
readers of JSON files take its result, stored, in place of the root.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict import schemas
from veridict.functions.text import collapse_space, fraction, once, seed_of, strip

JUDGE, ANSWERS, SUMMARY, TOPICS = "*_judge_result.json", "*_result.json", "*_summary.json", "topics_*.json"
_META = {
    "file_path": "_metadata.file_path", "file_name": "_metadata.file_name", "modified": "_metadata.file_modification_time",
}


def _part(n: int) -> Column:
    """The path's n-th part from the end."""
    return F.try_element_at(F.split("file_path", "/"), F.lit(-n))


#: Tasks that list and read a tree, for each core, and the bytes of a batch: files are many and small.
READERS_A_CORE, BATCH_BYTES = 4, 1 << 22


def _entries(folder: str) -> list[os.DirEntry]:
    """What a folder holds, by the rules of Spark's readers for names that are passed over."""
    with os.scandir(folder) as found:
        return [e for e in found if not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_"))]


def _uri(path: str) -> str:
    """A local path as Spark's readers name it."""
    return "file:" + re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", path)


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files among the given paths, and what the folders among them hold."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = [e.path for e in _entries(path)] if os.path.isdir(path) else [path]
            for k in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 10_000], pa.string())], names=["path"])


def _files(path: str) -> Iterator[tuple[str, os.stat_result]]:
    if not os.path.isdir(path):
        yield path, os.stat(path)
        return
    for e in _entries(path):
        if e.is_dir():
            yield from _files(e.path)
        else:
            yield e.path, e.stat()


def scan(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """All matching files below ``root`` as file_path, file_name, modified, value, each read once: store it, and give it to readers.

    Of a folder that the machines share, tasks list and read the files, so the
    driver holds none of their names; other file systems are read by Spark's
    reader, which lists them on the driver once.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    if at.getFileSystem(hadoop).getUri().getScheme() != "file":
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        return reader.text(root).select(*(F.col(v).alias(k) for k, v in _META.items()), "value")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = ["file_path", "file_name", "modified", "value"], [], 0
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path, stat in (f for p in batch.column("path").to_pylist() for f in _files(p)):
                if not fnmatch.fnmatchcase(os.path.basename(path), pattern):
                    continue
                with open(path, "rb") as file:
                    value = file.read()
                uri = _uri(path)
                held.append((uri, uri.rpartition("/")[2], stat.st_mtime_ns // 1_000_000, value))
                size += len(value)
                if size >= BATCH_BYTES or len(held) >= 10_000:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    tasks = READERS_A_CORE * spark.sparkContext.defaultParallelism
    paths = spark.createDataFrame([(at.toUri().getPath(),)], "path string")
    for _ in range(2):  # a root holds few generators, these hold the runs, which are dealt over tasks
        paths = paths.mapInArrow(_below, "path string").repartition(tasks, "path")
    found = paths.mapInArrow(read, "file_path string, file_name string, modified bigint, value binary")
    return found.select("file_path", "file_name", F.timestamp_millis("modified").alias("modified"), F.col("value").cast("string").alias("value"))


def _matches(pattern: str) -> Column:
    return F.col("file_name").rlike("^" + fnmatch.translate(pattern))


def read_tree(spark: SparkSession, root: str | DataFrame, pattern: str, schema: str) -> DataFrame:
    """Rows of all matching files below ``root`` with run_dir, run, generator, file_name and modified.

    A file holds one object or an array; what else its array holds is passed
    over, row by row.  A field of another type than ``schema`` says is null.
    """
    if isinstance(root, DataFrame):
        texts = root.where(_matches(pattern))
    else:
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        texts = reader.text(root).select(*(F.col(v).alias(k) for k, v in _META.items()), "value")
    listed = once(F.try_parse_json("value"), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    objects = F.filter(listed, lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    # parsed inside the array, which an outer explode makes once: filters on what it gives would read every file again
    parsed = F.transform(objects, lambda v: F.from_json(F.to_json(v), schema, {"mode": "PERMISSIVE"}))
    rows = texts.select(*_META, F.explode_outer(parsed).alias("r"))
    found = rows.where("r is not null").select("r.*", *_META)
    return found.withColumns({"run_dir": F.regexp_replace("file_path", "/[^/]*$", ""), "run": _part(2), "generator": _part(3)})


#: Patterns of the files that a run's folder may hold.
ARTIFACTS = ("manifest.json", JUDGE, ANSWERS, SUMMARY, "summary_all_judges.json")


def run_dirs(
    spark: SparkSession, root: str | DataFrame, pattern: str = "*", artifacts: tuple[str, ...] = (SUMMARY,), containing: str = ""
) -> DataFrame:
    """run_dir and run of all folders that hold one of ``artifacts`` and whose name matches a shell pattern.

    Names must contain ``containing``, too.  Only paths are read, no file.
    """
    found = None
    for kind in artifacts:
        if isinstance(root, DataFrame):
            paths = root.where(_matches(kind)).select("file_path")
        else:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", kind).load(root)
            paths = files.select(F.col("path").alias("file_path"))
        found = paths if found is None else found.unionByName(paths)
    named = found.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("run_dir"), _part(2).alias("run")).distinct()
    return named.where(F.col("run").rlike("^" + fnmatch.translate(pattern)) & F.contains("run", F.lit(containing)))


def read_ratings(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """Judge ratings as run_id, unit, judge, generator, verdict, score, output_valid.

    The judge comes from the file name, the verdict from the rating or its
    parsed output or, failing both, its logical validity; a score is a whole
    number ("3.0" is none, 3.7 is 3).
    """
    rows = read_tree(spark, root, JUDGE, schemas.RATING)
    score = F.coalesce("judge_medical_accuracy_score", "judge_json.medical_accuracy_score")
    whole = F.when(score.rlike(r"^\s*[+-]?\d+\s*$"), score.try_cast("int")).when(
        score.rlike(r"^\d+\.\d*[1-9]\d*$"), F.floor(score.try_cast("double")).cast("int")
    )
    fallback = F.when(F.col("judge_json.logical_validity"), "PASS").when(~F.col("judge_json.logical_validity"), "FAIL")
    verdict = F.upper(strip(F.coalesce("judge_verdict", "judge_json.verdict")))
    return rows.select(
        F.col("run_dir").alias("run_id"), F.col("question_id").alias("unit"),
        F.regexp_extract("file_name", r"^(.*)_judge_result\.json$", 1).alias("judge"), "generator",
        F.coalesce(F.when(verdict.isin("PASS", "FAIL"), verdict), fallback).alias("verdict"), whole.alias("score"),
        F.col("judge_output_valid").alias("output_valid"), F.coalesce("judge_fail_reason", "judge_json.fail_reason").alias("fail_reason"),
    ).where("unit is not null")


def read_answers(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """Answers as run_id, generator, unit, model, gold, pred, topic; judge files are left out."""
    rows = read_tree(spark, root, ANSWERS, schemas.ANSWER).where(~F.col("file_name").endswith("_judge_result.json"))
    return rows.select(
        F.col("run_dir").alias("run_id"), "generator", F.col("question_id").alias("unit"),
        F.regexp_extract("file_name", r"^(.*)_result\.json$", 1).alias("model"), F.col("answer").alias("gold"), "pred",
        F.coalesce("abms_specialty", "target_topic", "topic").alias("topic"), "quiz_id",
    )


def item_level(answers: DataFrame) -> DataFrame:
    """model, quiz_id, question_id, correct (no answer is 0); rows without an id or a gold letter are left out."""
    there = (F.coalesce("quiz_id", F.lit("")) != "") & (F.coalesce("unit", F.lit("")) != "") & (F.coalesce("gold", F.lit("")) != "")
    right = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("int")
    return answers.where(there).select("model", "quiz_id", F.col("unit").alias("question_id"), right.alias("correct"))


def read_answer_summaries(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """Answer summaries with run_dir, run and generator; a missing accuracy is 0, judge summaries are left out."""
    rows = read_tree(spark, root, SUMMARY, schemas.ANSWER_SUMMARY)
    rows = rows.where(~F.col("file_name").endswith("_judge_summary.json"))
    return rows.withColumn("acc", F.coalesce("acc", F.lit(0.0)))


def read_judge_summaries(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """Judge summaries; a run without files of its own judges uses its ``summary_all_judges.json``."""
    own = read_tree(spark, root, "*_judge_summary.json", schemas.JUDGE_SUMMARY)
    old = read_tree(spark, root, "summary_all_judges.json", schemas.JUDGE_SUMMARY)
    return own.unionByName(old.join(own.select("run_dir").distinct(), "run_dir", "left_anti").select(*own.columns))


def items_per_run(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """run_dir and n_items: of the takers' summaries (the first by file name), else of the judges'."""
    first = lambda df, name: df.groupBy("run_dir").agg(F.min_by("n_items", "file_name").alias(name))
    both = first(read_answer_summaries(spark, root), "a").join(first(read_judge_summaries(spark, root), "b"), "run_dir", "full_outer")
    return both.select("run_dir", F.coalesce("a", "b").alias("n_items"))


def run_sizes(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """run_dir, n_items: of the run's manifest, else the greatest of its summaries, else 0; only numbers above 0 count."""
    above = lambda c: F.max(F.when(F.col(c) > 0, F.col(c)))
    own = read_tree(spark, root, "manifest.json", "n_items long, created_at string").groupBy("run_dir").agg(above("n_items").alias("a"))
    kinds = (SUMMARY, "summary_all_judges.json")
    rows = [read_tree(spark, root, k, "model string, n_items long").select("run_dir", "n_items") for k in kinds]
    other = rows[0].unionByName(rows[1]).groupBy("run_dir").agg(above("n_items").alias("b"))
    return own.join(other, "run_dir", "full_outer").select("run_dir", F.coalesce("a", "b", F.lit(0)).alias("n_items"))


def consistent_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries whose counts add up and whose accuracy agrees with them to 1e-6."""
    total = F.col("total_corr") + F.col("total_wrong")
    near = F.abs(F.col("acc") - F.try_divide(F.col("total_corr").cast("double"), F.col("n_items"))) <= 1e-6
    return summaries.where((total == F.col("n_items")) & F.coalesce(near, F.col("n_items") == 0))


def missing_work(quizzes: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """Quizzes (quiz_id, n_items or null) without a consistent summary by ``model`` of the expected size."""
    done = consistent_summaries(summaries).where(F.col("model") == model).select(F.col("run").alias("quiz_id"), F.col("n_items").alias("_n"))
    met = quizzes.join(done, "quiz_id").where(F.col("n_items").isNull() | (F.col("n_items") == F.col("_n"))).select("quiz_id")
    return quizzes.join(met.distinct(), "quiz_id", "left_anti")


def partial_runs(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """run_dir, model and state (no_summary or no_result) where only one of the two files is there."""
    a = results.select(F.col("run_id").alias("run_dir"), "model").distinct().withColumn("r", F.lit(1))
    b = summaries.select("run_dir", "model").distinct().withColumn("s", F.lit(1))
    both = a.join(b, ["run_dir", "model"], "full_outer").where("r is null or s is null")
    return both.select("run_dir", "model", F.when(F.col("s").isNull(), "no_summary").otherwise("no_result").alias("state"))


def read_manifest_quizzes(spark: SparkSession, root: str, pattern: str = "*manifest*.json") -> DataFrame:
    """A row for each quiz that a manifest lists, with its place (pos), file_path and modified."""
    rows = read_tree(spark, root, pattern, schemas.MANIFEST)
    listed = rows.select(
        F.col("generator_model").alias("manifest_generator"), "file_path", "file_name", "modified", F.posexplode("quizzes").alias("pos", "q"),
        F.coalesce("num_questions_per_quiz", "chunk_size").alias("n_items"),
    )
    quiz = listed.select("*", "q.*").drop("q")
    return quiz.withColumns(
        {"generator": F.coalesce("generator_model", "manifest_generator"), "seed": F.coalesce("seed", seed_of(F.col("quiz_id")))}
    )


def legacy_manifests(quizzes: DataFrame, root: str, name: str = "quizbench_manifest.json") -> DataFrame:
    """Quizzes of manifests without a tag, in the root folder or one level below it."""
    below = F.replace(F.regexp_replace("file_path", "^[a-z0-9]+:/*", "/"), F.lit(root.split(":", 1)[-1].rstrip("/") + "/"), F.lit(""))
    return quizzes.where((F.col("file_name") == name) & (F.size(F.split(below, "/")) <= 2))


def newest_manifest(quizzes: DataFrame) -> DataFrame:
    """The quizzes of the newest manifest (then the last by name)."""
    newest = quizzes.agg(F.max_by("file_path", F.struct("modified", "file_name")).alias("file_path"))
    return quizzes.join(newest, "file_path", "left_semi")


def generators_of_newest(quizzes: DataFrame) -> DataFrame:
    """quiz_id, generator by the newest manifest of each folder; of a quiz in several folders the last counts."""
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    newest = quizzes.groupBy(folder.alias("_folder")).agg(F.max_by("file_path", F.struct("modified", "file_name")).alias("file_path"))
    kept = quizzes.join(newest.select("file_path"), "file_path", "left_semi").where("generator is not null")
    return kept.groupBy("quiz_id").agg(F.max_by("generator", F.struct("file_path", "pos")).alias("generator"))


def quiz_generators(quizzes: DataFrame, last_wins: bool = False) -> DataFrame:
    """quiz_id, generator, and whether manifests disagree about it.

    The first manifest by path wins, or with ``last_wins`` the newest.
    """
    order = F.struct("modified", "file_path", "pos") if last_wins else F.struct("file_path", "pos")
    chosen = F.max_by("generator", order) if last_wins else F.min_by("generator", order)
    return quizzes.where("generator is not null").groupBy("quiz_id").agg(
        chosen.alias("generator"), (F.count_distinct("generator") > 1).alias("conflict")
    )


def merge_manifests(quizzes: DataFrame) -> DataFrame:
    """One entry for each quiz: the most complete one, its gaps filled from the others in order of path."""
    fields = ["quiz_path", "generator", "seed", "target_topic"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    over = Window.partitionBy("quiz_id").orderBy(filled.desc(), "file_path", "pos")
    ranked = quizzes.withColumn("_rank", F.row_number().over(over))
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank")))
    return ranked.groupBy("quiz_id").agg(*(best(c).alias(c) for c in fields))


def read_topics(spark: SparkSession, root: str, generators: tuple[str, ...] = (), evaluators: tuple[str, ...] = ()) -> DataFrame:
    """A row for each labelled question with its file; a missing label is "unknown", a missing id is made from the place.

    Only files of the given generators and evaluators, if any are given.
    """
    rows = read_tree(spark, root, TOPICS, schemas.TOPICS)
    for column, names in (("generator", generators), ("eval_model", evaluators)):
        rows = rows.where(F.col(column).isin(list(names))) if names else rows
    each = rows.select(
        "run_dir", "run", "generator", "file_name", "modified", "eval_model", F.col("topic_mapping.applied_at").alias("applied_at"), "quiz_id",
        F.posexplode("per_question").alias("pos", "q"),
    )
    made = F.format_string("%s-%03d", F.coalesce("quiz_id", "run"), F.col("pos") + 1)
    return each.select(
        "run_dir", "run", "generator", "file_name", "modified", "eval_model", "applied_at", F.coalesce("q.question_id", made).alias("question_id"),
        F.coalesce("q.topic", F.lit("unknown")).alias("topic"), F.col("q.topic_mapped").alias("topic_mapped"), "pos",
    )


def choose_topics(topics: DataFrame, eval_model: str | None = None, policy: str = "misses") -> DataFrame:
    """The questions of one topics file for each run.

    ``misses`` prefers the evaluator, then more "_mapped" in the name, then the
    name; ``subset`` takes the newest file whose name ends in "_mapped".
    ``planner`` and ``accumulate`` demand the evaluator if one is given.  Of
    its files ``planner`` takes a mapped one, the newest; ``accumulate`` the
    only mapped one, else the only mapped one whose name ends in "_mapped" or
    does not, else likewise an unmapped one.  Where these two can't decide, the
    run has one row without a question that says why in the column ``error``.
    """
    files = topics.groupBy("run_dir", "file_name").agg(
        F.max("eval_model").alias("eval_model"), F.max("applied_at").alias("applied_at"), F.max("modified").alias("modified")
    )
    match = F.coalesce(F.col("eval_model") == F.lit(eval_model), F.lit(False))
    ends = F.col("file_name").endswith("_mapped.json")
    name = lambda *rank: F.max_by("file_name", F.struct(*rank, "file_name")).alias("file_name")
    if policy == "misses":
        pick = files.groupBy("run_dir").agg(name(match, F.size(F.split("file_name", "_mapped"))))
        return topics.join(pick, ["run_dir", "file_name"], "left_semi")
    if policy == "subset":
        return topics.join(files.where(ends).groupBy("run_dir").agg(name("modified")), ["run_dir", "file_name"], "left_semi")
    usable = files.where(match) if eval_model else files
    mapped = F.col("applied_at").isNotNull()
    if policy == "planner":
        mapped = mapped | F.col("file_name").contains("_mapped")
        pick = usable.groupBy("run_dir").agg(
            name(mapped, F.coalesce("applied_at", F.lit(""))),
            F.when((F.count_if(mapped) == 0) & (F.count("*") > 1), "several unmapped topics files").alias("error"),
        )
    else:
        only = lambda test: F.when(F.count_if(test) == 1, F.max(F.when(test, F.col("file_name"))))
        steps = [F.when(F.count("*") == 1, F.max("file_name")), only(mapped), only(mapped & ends), only(mapped & ~ends), only(~mapped & ends), only(~mapped & ~ends)]
        chosen = F.coalesce(*steps)
        pick = usable.groupBy("run_dir").agg(chosen.alias("file_name"), F.when(chosen.isNull(), "several topics files").alias("error"))
    none = files.select("run_dir").distinct().join(pick.select("run_dir"), "run_dir", "left_anti")
    none = none.withColumn("error", F.lit("no topics file of the evaluator"))
    good = topics.join(pick.where("error is null").select("run_dir", "file_name"), ["run_dir", "file_name"], "left_semi")
    errors = pick.where("error is not null").select("run_dir", "error").unionByName(none)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def question_topics(chosen: DataFrame, field: str = "auto") -> DataFrame:
    """run_dir, question_id and topic: the mapped label, the raw one, or by ``auto`` the mapped where there is one."""
    label = {"auto": F.coalesce("topic_mapped", "topic"), "mapped": F.col("topic_mapped"), "raw": F.col("topic")}[field]
    return chosen.select("run_dir", "question_id", collapse_space(label).alias("topic")).where("topic <> ''")


def read_quiz_items(spark: SparkSession, root: str) -> DataFrame:
    """Items of JSON-lines quizzes; a line that is not JSON fails the read."""
    reader = spark.read.schema(schemas.ITEM).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", "*.jsonl").json(root).select("*", *(F.col(v).alias(k) for k, v in _META.items()))


def count_quiz_lines(spark: SparkSession, root: str) -> DataFrame:
    """file_path and the number of its lines that are JSON objects (others are passed over)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    good = F.from_json("value", "map<string,string>").isNotNull() & F.startswith(F.trim("value"), F.lit("{"))
    return lines.select(F.col("_metadata.file_path").alias("file_path"), good.alias("g")).groupBy("file_path").agg(F.count_if("g").alias("n"))


def target_topics(spark: SparkSession, root: str) -> DataFrame:
    """file_path, line (from 0) and target_topic of every line of the quizzes, in order."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    each = files.select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(lines).alias("line", "value"))
    return each.select("file_path", "line", F.get_json_object("value", "$.target_topic").alias("target_topic"))


def newest_by_stem(files: DataFrame) -> DataFrame:
    """stem and file_path: the newest file (then the last path) of each name without its ending."""
    stem = F.regexp_replace(F.try_element_at(F.split("file_path", "/"), F.lit(-1)), r"\.[^.]*$", "")
    return files.select(stem.alias("stem"), "file_path", "modified").groupBy("stem").agg(
        F.max_by("file_path", F.struct("modified", "file_path")).alias("file_path")
    )


def read_selection(spark: SparkSession, root: str) -> DataFrame:
    """A row for each selected question of the selection reports."""
    rows = read_tree(spark, root, "selection_report*.json", schemas.SELECTION)
    return rows.select("subset_tag", "generator_model", "judge_models", F.explode("selected").alias("s")).select(
        "subset_tag", "generator_model", "judge_models", "s.*"
    )


def read_extra_results(spark: SparkSession, path: str) -> DataFrame:
    """generator, model, acc and n_items of given results; rows without a number are dropped."""
    rows = spark.read.schema(schemas.EXTRA_RESULTS).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    out = rows.select(
        F.col("r.quiz_generator").alias("generator"), F.col("r.model").alias("model"), F.col("r.accuracy").try_cast("double").alias("acc"),
        F.col("r.n_items").try_cast("long").alias("n_items"),
    )
    return out.where("acc is not null and not isnan(acc)")


def batch_lines(outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """custom_id and line of batch output and error files (column value, JSON lines); an error overrides an output."""
    both = outputs.select("value", F.lit(0).alias("p")).unionByName(errors.select("value", F.lit(1).alias("p")))
    keyed = both.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), "value", "p").where("custom_id is not null")
    return keyed.groupBy("custom_id").agg(F.max_by("value", F.struct("p", "value")).alias("line"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*(c.replace("﻿", "").strip() for c in rows.columns))


def read_targets(spark: SparkSession, path: str, category: str = "Specialty", number: str = "Number") -> DataFrame:
    """category, target and ord (the place in the file); repeated, negative or missing entries are an error.

    A targets file is a short list: it is read as one text, so that the order
    of its lines counts.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split(F.replace("value", F.lit("\ufeff"), F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    cells = text.select(F.posexplode(lines).alias("ord", "line"))
    header = cells.where("ord = 0").first()
    names = [c.strip().strip('"') for c in header.line.split(",")] if header else []
    if not {category, number} <= set(names):
        raise ValueError(f"expected the columns {category} and {number}")
    parsed = cells.where("ord > 0").withColumn("c", F.from_csv("line", ", ".join(f"c{k} string" for k in range(len(names)))))
    cell = lambda name: F.trim(F.col(f"c.c{names.index(name)}"))
    rows = parsed.select(cell(category).alias("category"), cell(number).try_cast("int").alias("target"), (F.col("ord") - 1).alias("ord"))
    bad = rows.groupBy("category").agg(F.count("*").alias("n"), F.min(F.coalesce("target", F.lit(-1))).alias("t")).where("n > 1 or t < 0 or category = ''")
    if not bad.isEmpty():
        raise ValueError(f"unusable target: {bad.first().category!r}")
    return rows


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """model, mean_acc, sem and n_quizzes of an accuracy table, best first."""
    rows = _csv(spark, path)
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    out = rows.select(
        pick("model").alias("model"), pick("mean_accuracy", "mean_acc", "accuracy").try_cast("double").alias("mean_acc"),
        pick("sem", "sem_accuracy").try_cast("double").alias("sem"), pick("n_quizzes", "n").try_cast("int").alias("n_quizzes"),
    )
    return out.where("model <> '' and mean_acc is not null").orderBy(F.desc("mean_acc"), F.lower("model"))


def read_cost(spark: SparkSession, path: str) -> DataFrame:
    """model and cost; of repeated models the last line counts, lines without a number are passed over."""
    rows = _csv(spark, path).select(strip(F.col("model")).alias("model"), F.col("cost_per_quiz").try_cast("double").alias("cost"))
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())  # rises with the line within one short file
    return numbered.where("cost is not null and model <> ''").groupBy("model").agg(F.max_by("cost", "_at").alias("cost"))


def read_validity(spark: SparkSession, path: str) -> DataFrame:
    """model and validity as a fraction; percentages are divided by 100."""
    rows = _csv(spark, path)
    return rows.select(strip(F.col("model")).alias("model"), fraction(F.col("questions_passing_percent")).alias("validity"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """generator, n_valid, n_total, n_invalid, rate of a table whose columns have these names or generator_model, valid, total, in any case.

    The example generator is left out; missing columns and entries that are
    blank, no whole numbers, or no counts are errors.
    """
    rows = _csv(spark, path)
    names = {c.lower(): c for c in rows.columns}
    wanted = {"generator": "generator_model", "n_valid": "valid", "n_total": "total"}
    lacking = [c for c, other in wanted.items() if c not in names and other not in names]
    if lacking:
        raise ValueError(f"{path}: missing columns {lacking}")
    cell = lambda c: F.col(names.get(c, names.get(wanted[c], "")))
    found = rows.select(strip(cell("generator")).alias("generator"), *(cell(c).try_cast("double").cast("long").alias(c) for c in ("n_valid", "n_total")))
    found = found.where(F.coalesce(F.lower("generator"), F.lit("")) != "_example")
    bad = F.col("generator").isNull() | (F.col("generator") == "") | F.col("n_valid").isNull() | F.col("n_total").isNull() | (F.col("n_total") <= 0) | ~F.col("n_valid").between(0, F.col("n_total"))
    state = found.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if state.bad or not state.n:
        raise ValueError(f"{path}: {state.bad} unusable of {state.n} rows")
    return found.withColumns({"n_invalid": F.col("n_total") - F.col("n_valid"), "rate": F.col("n_valid") / F.col("n_total")})


def validity_from_log(spark: SparkSession, path: str, tag: str = "") -> DataFrame:
    """generator, n_valid, n_total out of a log: the lines from the first header on to a blank one, TOTAL left out.

    The log is read as one text: it is short, and the order of its lines counts.
    """
    label = "[INFO] Questions passing judge filters" + (f" (tagged manifests: {tag})" if tag else "")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    first = lines.where(F.contains("line", F.lit(label))).agg(F.min("at").alias("first"))
    after = lines.join(F.broadcast(first), F.col("at") > F.col("first"))  # one row of one number
    blank = after.where(F.trim("line") == "").agg(F.coalesce(F.min("at"), F.lit(2**31 - 1)).alias("last"))
    part = lambda k: F.regexp_extract("line", r"^\s*(.+?):\s*valid=([0-9]+)\s*/\s*total=([0-9]+)\s*\(", k)
    found = after.join(F.broadcast(blank), F.col("at") < F.col("last"))
    found = found.select(strip(part(1)).alias("generator"), part(2).try_cast("int").alias("n_valid"), part(3).try_cast("int").alias("n_total"))
    return found.where("generator <> '' and generator <> 'TOTAL' and lower(generator) <> '_example'")
