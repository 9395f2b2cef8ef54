"""Accuracy of answering models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sem(value: str) -> Column:
    """Standard error of the mean; null for one row."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def margin(key: str, label: str) -> Column:
    """A key of a cube or rollup, ``label`` in its margin; needs ``grouping(key)`` as _all_<key>.  A null key stays null."""
    return F.when(F.col(f"_all_{key}") == 1, F.lit(label)).otherwise(F.col(key))


def correct() -> Column:
    """Whether pred equals the stripped gold letter (pred is not stripped)."""
    return F.col("pred") == F.trim("gold")


def run_accuracy(answers: DataFrame) -> DataFrame:
    """Accuracy per run and model over answered questions; models with none are left out."""
    answered = answers.where(F.col("pred").isNotNull())
    return answered.groupBy("run_id", "generator", "model").agg(
        (F.count_if(correct()) / F.count("*")).alias("acc"), F.count("*").alias("n_items")
    )


def macro_accuracy(runs: DataFrame, *keys: str) -> DataFrame:
    """Mean over runs of the accuracy, its standard error and the number of runs."""
    return runs.groupBy(*keys).agg(
        F.round(F.avg("acc"), 6).alias("mean_acc"), F.round(sem("acc"), 6).alias("sem"), F.count("*").alias("n_quizzes")
    )


def accuracy_matrix(runs: DataFrame) -> DataFrame:
    """Generator by model means with margins (ALL); a margin is the mean of all runs, not of cells."""
    out = runs.cube("generator", "model").agg(
        F.round(F.avg("acc"), 6).alias("mean_acc"), F.count("*").alias("n_quizzes"),
        F.grouping("generator").alias("_all_generator"), F.grouping("model").alias("_all_model"),
    )
    return out.select(margin("generator", "ALL").alias("generator"), margin("model", "ALL").alias("model"), "mean_acc", "n_quizzes")


def with_extra_results(runs: DataFrame, extra: DataFrame) -> DataFrame:
    """Append given accuracies (generator, model, acc, n_items) of known generators as one run each."""
    known = runs.select("generator").distinct()
    more = extra.join(known, "generator", "left_semi").select(
        F.concat_ws("/", F.lit("extra"), "generator", "model").alias("run_id"), "generator", "model", "acc", "n_items"
    )
    return runs.unionByName(more)


def evaluator_summary(answers: DataFrame, *keys: str) -> DataFrame:
    """total_corr, total_wrong and acc with every question counted: no answer is a wrong one."""
    right = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    out = answers.groupBy(*keys).agg(F.count_if(right).alias("total_corr"), F.count_if(~right).alias("total_wrong"))
    total = F.col("total_corr") + F.col("total_wrong")
    return out.withColumn("acc", F.round(F.col("total_corr") / F.greatest(F.lit(1), total), 6))


def miss_rates(answers: DataFrame, *keys: str) -> DataFrame:
    """Misses (no answer counts as one; both letters stripped), questions and rate."""
    miss = ~F.coalesce(F.trim("pred") == F.trim("gold"), F.lit(False))
    out = answers.groupBy(*keys).agg(F.count_if(miss).alias("n_missed"), F.count("*").alias("n_total"))
    return out.withColumn("miss_rate", F.round(F.col("n_missed") / F.col("n_total"), 6))


def topic_misses(attempts: DataFrame, unique_questions: bool = False) -> DataFrame:
    """group (quiz or ALL), topic, n_missed, share of the group's misses.

    Counts miss events, or with ``unique_questions`` each missed question once
    per group; ALL is then the sum over the groups, not a distinct count.
    """
    missed = attempts.where("y = 0")
    if unique_questions:
        missed = missed.select("quiz", "topic", "item").distinct()
    out = missed.cube("quiz", "topic").agg(F.count("*").alias("n"), *_margins())
    cells, totals = _cells_and_totals(out, "n")
    return _beside(cells, totals).select(
        "group", "topic", F.col("n").alias("n_missed"), F.round(F.col("n") / F.col("total_n"), 6).alias("share")
    )


def _margins() -> list[Column]:
    return [F.grouping("quiz").alias("_all_quiz"), F.grouping("topic").alias("_all_topic")]


def _cells_and_totals(out: DataFrame, *counts: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a cube by quiz and topic, and the totals of each quiz and of ALL as total_<count>."""
    named = margin("quiz", "ALL").alias("group")
    cells = out.where("_all_topic = 0").select(named, "_all_quiz", "topic", *counts)
    return cells, out.where("_all_topic = 1").select(named, "_all_quiz", *(F.col(c).alias(f"total_{c}") for c in counts))


def _beside(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Cells with their group's totals; a null quiz is a group of its own."""
    totals = totals.withColumnsRenamed({"group": "_group", "_all_quiz": "_all"})
    return cells.join(totals, F.col("group").eqNullSafe(F.col("_group")) & (F.col("_all_quiz") == F.col("_all")))


def miss_enrichment(attempts: DataFrame) -> DataFrame:
    """Per group (quiz or ALL) and topic with misses: miss rate, prevalence, share of misses and over/under ratio."""
    out = attempts.cube("quiz", "topic").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("m"), *_margins())
    cells, totals = _cells_and_totals(out, "n", "m")
    own = _beside(cells.where("m > 0"), totals)
    prevalence, share = F.col("n") / F.col("total_n"), F.col("m") / F.col("total_m")
    return own.select(
        "group", "topic", F.col("n").alias("n_total"), F.col("m").alias("n_missed"),
        F.round(F.col("m") / F.col("n"), 6).alias("miss_rate"), F.round(prevalence, 6).alias("prevalence"),
        F.round(share, 6).alias("miss_share"), F.round(F.try_divide(share, prevalence), 6).alias("over_under"),
    )


def enrichment_order(rows: DataFrame) -> DataFrame:
    """ALL first, then by group, over/under ratio, miss rate and misses (descending, missing ratios last), topic."""
    ratio = F.when(F.col("over_under") == 0, None).otherwise(F.col("over_under"))
    return rows.orderBy(
        F.when(F.col("group") == "ALL", 0).otherwise(1), "group", F.desc_nulls_last(ratio),
        F.desc_nulls_last("miss_rate"), F.desc("n_missed"), "topic",
    )


def topic_extremes(attempts: DataFrame) -> DataFrame:
    """Pooled accuracy's hardest and easiest topic of every quiz and ALL; ties go to the first name."""
    cells = attempts.cube("quiz", "topic").agg(F.avg("y").alias("acc"), *_margins())
    own = cells.where("_all_topic = 0").select(margin("quiz", "ALL").alias("group"), "topic", "acc")
    return own.groupBy("group").agg(
        F.min_by("topic", F.struct("acc", "topic")).alias("hardest"), F.round(F.min("acc"), 6).alias("lowest"),
        F.min_by("topic", F.struct(-F.col("acc"), F.col("topic"))).alias("easiest"), F.round(F.max("acc"), 6).alias("highest"),
    )


def cutoff_accuracy(answers: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per cutoff and model: mean over runs and its error, pooled accuracy and items; ``accepted`` has cutoff, run_id, unit."""
    answered = answers.where(F.col("pred").isNotNull()).join(accepted, ["run_id", "unit"])
    runs = answered.groupBy("cutoff", "model", "run_id").agg(F.count_if(correct()).alias("c"), F.count("*").alias("n"))
    runs = runs.withColumn("acc", F.col("c") / F.col("n"))
    return runs.groupBy("cutoff", "model").agg(
        F.round(F.avg("acc"), 6).alias("mean_acc"), F.round(sem("acc"), 6).alias("sem"),
        F.round(F.sum("c") / F.sum("n"), 6).alias("micro_acc"), F.sum("n").alias("n_items"),
    )


def pairing_audit(attempts: DataFrame) -> DataFrame:
    """Per llm: items, repeated rows, items that other llms have and it lacks, observed accuracy."""
    per = attempts.groupBy("llm", "item").agg(F.count("*").alias("c"), F.avg("y").alias("y"))
    own = per.groupBy("llm").agg(
        F.count("*").alias("n_items"), F.sum(F.col("c") - 1).alias("n_repeats"), F.round(F.avg("y"), 6).alias("accuracy")
    )
    total = attempts.agg(F.count_distinct("item").alias("all_items"))
    return own.join(F.broadcast(total)).select(  # one row of one number
        "llm", "n_items", "n_repeats", (F.col("all_items") - F.col("n_items")).alias("n_missing"), "accuracy"
    )


def complete_items(attempts: DataFrame) -> DataFrame:
    """Items that every llm has tried."""
    models = attempts.agg(F.count_distinct("llm").alias("k"))
    per = attempts.groupBy("item").agg(F.count_distinct("llm").alias("k"))
    return per.join(models, "k", "left_semi").select("item")


def paired_outcomes(attempts: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """item, llm, y of items that every llm has tried; or of all items, where what is missing counts as wrong.

    Of repeated attempts the greatest y counts.  Llms are few: they travel as one array.
    """
    own = attempts.groupBy("item", "llm").agg(F.max("y").alias("y"))
    if not missing_as_zero:
        whole = own.where("y is not null").join(complete_items(own.where("y is not null")), "item", "left_semi")
        return whole.select("item", "llm", "y")
    llms = attempts.agg(F.array_sort(F.collect_set("llm")).alias("llms"))
    grid = own.select("item").distinct().join(F.broadcast(llms), how="cross").select("item", F.explode("llms").alias("llm"))  # one row of llms
    return grid.join(own, ["item", "llm"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def described_items(attempts: DataFrame, metadata: DataFrame) -> DataFrame:
    """item, n, p (share of right answers) with the item's metadata, where it has any; ``metadata`` has one row an item."""
    scores = attempts.groupBy("item").agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("p"))
    return scores.join(metadata, "item", "left")


def item_difficulty(attempts: DataFrame) -> DataFrame:
    """Topic, items, mean share of correct answers, and rank from the hardest (ties by name)."""
    items = attempts.groupBy("item", "topic").agg(F.avg("y").alias("p"))
    topics = items.groupBy("topic").agg(F.count("*").alias("n_items"), F.avg("p").alias("p"))
    # topics are few: the rank is their position in a sorted array
    order = topics.agg(F.sort_array(F.collect_list(F.struct("p", "topic"))).alias("o"))
    ranked = order.select(F.posexplode("o").alias("k", "e")).select((F.col("k") + 1).alias("rank"), "e.topic")
    return topics.join(ranked, "topic").select("topic", "n_items", F.round("p", 6).alias("mean_p"), "rank")
