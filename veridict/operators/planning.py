"""What a planner of further quizzes needs: topics of questions with reasons where there are none, targets without a valid
question, and samples of topics to ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridict.functions.text import strip

#: Why a run has no topics.
NO_ROWS, NO_FILES, NO_QUIZ, NO_TOPICS = "no_topics_rows", "no_topics_files", "no_topics_files_and_missing_quiz_jsonl", "no_topics_found_in_quiz_jsonl"


def sourced_topics(runs: DataFrame, labelled: DataFrame, quiz: DataFrame, fallback: bool = True) -> DataFrame:
    """run, question_id, topic, source (topics or quiz) and error: the topics of every run, or one row that says why it has none.

    ``runs`` has run.  ``labelled`` has run, question_id, topic, error of the
    topics files chosen for runs (an error in place of questions), ``quiz``
    run, line (from 0), question_id, topic of quiz lines.  A run with topics
    files never falls back; a question without an id in a quiz gets one from
    its line; questions without a topic are left out, and of repeated ones the
    last in order of topic counts.
    """
    made = F.format_string("%s-%03d", "run", F.col("line") + 1)
    there = lambda c: F.when(strip(F.col(c)) != "", strip(F.col(c)))
    files = labelled.select("run", F.lit(0).alias("source"), there("question_id").alias("question_id"), "topic", "error")
    lines = quiz.select("run", F.lit(1).alias("source"), F.coalesce(there("question_id"), made).alias("question_id"), "topic", F.lit(None).cast("string").alias("error"))
    every = files.unionByName(lines)
    usable = F.col("question_id").isNotNull() & F.col("topic").isNotNull() & F.col("error").isNull()
    of = lambda source, what: F.count_if((F.col("source") == source) & what)
    seen = every.groupBy("run").agg(
        of(0, F.lit(True)).alias("files"), of(0, usable).alias("labels"), F.min(F.when(F.col("source") == 0, F.col("error"))).alias("failed"),
        of(1, F.lit(True)).alias("lines"), of(1, usable).alias("topics"),
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    error = F.when(some("files"), F.when(F.col("failed").isNotNull(), F.col("failed")).when(~some("labels"), NO_ROWS))
    rest = F.when(~some("lines"), NO_QUIZ).when(~some("topics"), NO_TOPICS)
    error = error.when(~some("files"), rest) if fallback else error.when(~some("files"), F.lit(NO_FILES))
    status = runs.select("run").distinct().join(seen, "run", "left").select("run", F.when(some("files"), 0).otherwise(1).alias("source"), error.alias("reason"))
    kept = every.where(usable).groupBy("run", "source", "question_id").agg(F.max("topic").alias("topic"))
    found = status.where("reason is null").join(kept, ["run", "source"]).select("run", "question_id", "topic", "source", F.lit(None).cast("string").alias("error"))
    none = status.where("reason is not null").select("run", *(F.lit(None).cast("string").alias(c) for c in ("question_id", "topic")), "source", F.col("reason").alias("error"))
    return found.unionByName(none).withColumn("source", F.when(F.col("source") == 0, "topics").otherwise("quiz"))


def vote_counts(questions: DataFrame, ratings: DataFrame, judges: int, min_score: int | None) -> DataFrame:
    """The questions (run, unit, ...) with counts of their judges' votes: eligible, passed, and why others are not eligible.

    ``ratings`` has run, unit, judge, output_valid, verdict, score; of repeated
    ratings of a judge one counts.  ``judged`` says whether anyone rated the run.
    """
    low = F.coalesce(F.col("score") < min_score, F.lit(True)) if min_score is not None else F.lit(False)
    valid = F.coalesce("output_valid", F.lit(False))
    votes = ratings.groupBy("run", "unit", "judge").agg(F.min(F.struct("output_valid", "verdict", "score")).alias("r")).select("run", "unit", "r.*")
    verdict = F.coalesce(F.upper(F.trim("verdict")), F.lit("MISSING"))
    eligible = valid & ~low
    counts = votes.groupBy("run", "unit").agg(
        F.count("*").alias("rows"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & (verdict == "PASS")).alias("passed"),
        F.count_if(eligible & (verdict == "FAIL")).alias("failed"), F.count_if(~valid).alias("invalid_output"), F.count_if(valid & low).alias("below_min_medical_score"),
    )
    rated = ratings.select("run").distinct().withColumn("judged", F.lit(True))
    out = questions.join(counts, ["run", "unit"], "left").join(rated, "run", "left")
    names = ("rows", "eligible", "passed", "failed", "invalid_output", "below_min_medical_score")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names} | {"judged": F.coalesce("judged", F.lit(False))})
    return out.withColumn("missing_result", F.greatest(F.lit(judges) - F.col("rows"), F.lit(0))).drop("rows")


def zero_valid_targets(
    targets: DataFrame, questions: DataFrame, ratings: DataFrame, runs: DataFrame, judges: int, min_score: int | None = None, allow_missing: bool = False
) -> DataFrame:
    """category, part, key, n: what became of the questions of target categories that have no valid one.

    ``questions`` has run, unit, topic, ``runs`` run and reason (null: the run
    counts; runs that are not listed are "untracked_run"), ``targets`` category.
    Parts: included (valid, or the reason), skipped (by reason), pass/eligible
    and verdicts of questions that failed by majority, ineligible (votes of
    questions that no judge was eligible for).
    """
    wanted = questions.withColumnRenamed("topic", "category").join(targets.select("category").distinct(), "category", "left_semi")
    counted = vote_counts(wanted.join(runs.select("run", "reason", F.lit(True).alias("_listed")), "run", "left"), ratings, judges, min_score)
    skipped = F.when(F.col("_listed").isNull(), "untracked_run").otherwise(F.col("reason"))
    status = (
        F.when(skipped.isNotNull(), F.lit("skipped"))
        .when(~F.col("judged"), "valid" if allow_missing else "no_judge_results_found")
        .when(F.col("eligible") == 0, "no_eligible_judges").when(2 * F.col("passed") > F.col("eligible"), "valid").otherwise("majority_fail")
    )
    cells = counted.select("category", skipped.alias("skipped"), status.alias("status"), "eligible", "passed", "failed", "missing_result", "invalid_output", "below_min_medical_score")
    # categories with a valid question drop out before anything is listed
    some = cells.groupBy("category").agg(F.count_if(F.col("status") == "valid").alias("v")).where("v = 0").select("category")
    bad = cells.join(some, "category")
    other = F.col("eligible") - F.col("passed") - F.col("failed")
    entry = lambda part, key, n=None: F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    failed, ineligible = F.col("status") == "majority_fail", F.col("status") == "no_eligible_judges"
    entries = F.array(
        F.when(F.col("status") == "skipped", entry("skipped", F.col("skipped"))).otherwise(entry("included", F.col("status"))),
        F.when(failed, entry("pass/eligible", F.concat_ws("/", F.col("passed").cast("string"), F.col("eligible").cast("string")))),
        *(F.when(failed, entry("verdicts", F.lit(k), n)) for k, n in (("PASS", F.col("passed")), ("FAIL", F.col("failed")), ("other", other))),
        *(F.when(ineligible, entry("ineligible", F.lit(k), F.col(k))) for k in ("missing_result", "invalid_output", "below_min_medical_score")),
    )
    each = bad.select("category", F.explode(F.filter(entries, lambda e: e.isNotNull() & (e["n"] > 0))).alias("e")).select("category", "e.*")
    listed = each.groupBy("category", "part", "key").agg(F.sum("n").alias("n"))
    absent = targets.select("category").distinct().join(wanted.select("category").distinct(), "category", "left_anti")
    return listed.unionByName(absent.select("category", F.lit("included").alias("part"), F.lit("none").alias("key"), F.lit(0).cast("long").alias("n")))


def audit(rows: DataFrame, filters: dict[str, Column], *keys: str) -> DataFrame:
    """A ledger in one pass: ``total`` rows, for each filter those that it is the first to drop, and what has ``passed`` all.

    ``filters`` are in order; a test that is null drops the row.
    """
    charge = reduce(lambda c, f: c.when(~F.coalesce(f[1], F.lit(False)), f[0]), filters.items(), F.when(F.lit(False), ""))
    charged = rows.select(*keys, charge.alias("_by"))
    by = [F.count_if(F.col("_by") == name).alias(name) for name in filters]
    return charged.groupBy(*keys).agg(F.count("*").alias("total"), *by, F.count_if(F.col("_by").isNull()).alias("passed"))


def score_audit(ratings: DataFrame, min_pass: int, min_total: int, *keys: str) -> DataFrame:
    """Units with scores, by whether enough verdicts, and enough of them PASS, stand beside the scores.

    ``ratings`` has unit, judge, verdict and score, either may be missing.
    """
    units = ratings.groupBy(*keys, "unit").agg(F.count("score").alias("s"), F.count("verdict").alias("v"), F.count_if(F.col("verdict") == "PASS").alias("p"))
    tests = {"missing_logical": F.col("v") > 0, "insufficient_logical": F.col("v") >= min_total, "failed_pass": F.col("p") >= min_pass}
    return audit(units.where("s > 0"), tests, *keys)


def sampled_topics(requests: DataFrame, topics: str = "topics", questions: str = "n", seed: str = "seed") -> DataFrame:
    """Append ``sampled``: of each request's topics (an array) max(5, half the number of questions), drawn by its seed.

    A topic's place is the md5 of seed and topic, so a sample depends on
    neither order nor repetition, and blank topics are left out.
    """
    given = F.array_distinct(F.filter(F.transform(topics, strip), lambda t: t != ""))
    drawn = F.array_sort(F.transform(given, lambda t: F.struct(F.md5(F.concat_ws("|", F.col(seed).cast("string"), t).cast("binary")).alias("h"), t.alias("t"))))
    size = F.greatest(F.lit(5), F.floor(F.col(questions) / 2).cast("int"))
    return requests.withColumn("sampled", F.coalesce(F.transform(F.slice(drawn, 1, size), lambda d: d["t"]), F.array().cast("array<string>")))


def plan_problem(plan: Column, counts: Column, questions: Column) -> Column:
    """Why a request's plan (array of topics) and counts (map) don't fit its number of questions or each other; null if they do."""
    planned = F.filter(F.transform(plan, strip), lambda t: t != "")
    asked = F.map_filter(counts, lambda k, v: (strip(k) != "") & (v > 0))
    total = F.aggregate(F.map_values(asked), F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    own = F.transform(F.array_distinct(planned), lambda t: F.struct(t.alias("key"), F.size(F.filter(planned, lambda x: x == t)).cast("long").alias("value")))
    given = F.transform(F.map_entries(asked), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("long").alias("value")))
    has_plan, has_counts = F.coalesce(F.size(planned) > 0, F.lit(False)), F.coalesce(F.size(asked) > 0, F.lit(False))
    return (
        F.when(has_plan & (F.size(planned) != questions), "topic_plan length != num_questions")
        .when(has_counts & (total != questions), "topic_counts sum != num_questions")
        .when(has_plan & has_counts & (F.array_sort(own) != F.array_sort(given)), "topic_counts mismatch topic_plan")
    )


def first_seen_topics(plan: Column) -> Column:
    """Topics of a plan in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(plan, strip), lambda t: t != ""))
