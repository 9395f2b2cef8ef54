"""Which questions do the judges accept?

Ratings have run_id, unit (the question), judge, verdict, score and
output_valid.  All filters are one aggregation by (run, unit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridict.operators.accuracy import margin


def eligible(min_score: int | None) -> Column:
    """A vote counts if its output is explicitly valid and its score reaches the minimum (when there is one)."""
    valid = F.coalesce(F.col("output_valid"), F.lit(False))
    if min_score is None:
        return valid
    return valid & F.coalesce(F.col("score") >= min_score, F.lit(False))


def passes() -> Column:
    return F.coalesce(F.upper(F.trim("verdict")) == "PASS", F.lit(False))


def accepted_units(
    ratings: DataFrame, judges: Sequence | None = None, min_score: int | None = 1, mode: str = "majority"
) -> DataFrame:
    """(run_id, unit) of accepted questions.

    Modes: ``majority`` - more than half of the eligible votes pass; ``all`` -
    every judge with any rating in the run has an eligible vote that passes;
    ``score`` - as ``all`` without looking at verdicts.  Runs without ratings
    have no rows: whether they stay unfiltered is decided by ``keep_accepted``.
    """
    if judges is not None:
        ratings = ratings.where(F.col("judge").isin(list(judges)))
    ok = eligible(min_score)
    if mode == "majority":
        votes = ratings.groupBy("run_id", "unit").agg(F.count_if(ok).alias("n"), F.count_if(ok & passes()).alias("p"))
        return votes.where(2 * F.col("p") > F.col("n")).select("run_id", "unit")
    if mode not in ("all", "score"):
        raise ValueError(f"unknown mode {mode!r}")
    ok = ok & passes() if mode == "all" else ok
    present = ratings.groupBy("run_id").agg(F.count_distinct("judge").alias("judges"))
    good = ratings.groupBy("run_id", "unit").agg(F.count_distinct(F.when(ok, F.col("judge"))).alias("good"))
    return good.join(present, "run_id").where("good = judges").select("run_id", "unit")


def keep_accepted(rows: DataFrame, ratings: DataFrame, **rule) -> DataFrame:
    """Rows (run_id, unit, ...) of accepted questions; runs that no judge has rated are left as they are."""
    judges = rule.get("judges")
    rated = ratings if judges is None else ratings.where(F.col("judge").isin(list(judges)))
    accepted = accepted_units(ratings, **rule)
    kept = rows.join(accepted, ["run_id", "unit"], "left_semi")
    return kept.unionByName(rows.join(rated.select("run_id").distinct(), "run_id", "left_anti").select(*rows.columns))


def validity_by_generator(units: DataFrame, accepted: DataFrame) -> DataFrame:
    """generator, n_total, n_valid, rate, with a TOTAL row; ``units`` has run_id, unit, generator."""
    flagged = units.join(accepted.withColumn("ok", F.lit(1)), ["run_id", "unit"], "left")
    out = flagged.rollup("generator").agg(F.count("*").alias("n_total"), F.count("ok").alias("n_valid"), F.grouping("generator").alias("_all_generator"))
    return out.select(
        margin("generator", "TOTAL").alias("generator"), "n_total", "n_valid",
        F.round(F.try_divide(F.col("n_valid").cast("double"), F.col("n_total")), 6).alias("rate"),
    )


def validity_by_scope(units: DataFrame, accepted: DataFrame, tagged: DataFrame) -> DataFrame:
    """``validity_by_generator`` over all runs, over those of ``tagged`` (column run_id) and over the others: scope all, tagged, legacy."""
    known = tagged.select("run_id").distinct()
    parts = {"all": units, "tagged": units.join(known, "run_id", "left_semi"), "legacy": units.join(known, "run_id", "left_anti")}
    scoped = [validity_by_generator(part, accepted).withColumn("scope", F.lit(name)) for name, part in parts.items()]
    return scoped[0].unionByName(scoped[1]).unionByName(scoped[2])


def unexpected_totals(validity: DataFrame, expected: int) -> DataFrame:
    """Generators whose number of questions is not the expected one; the TOTAL row is left out."""
    return validity.where((F.col("generator") != "TOTAL") & (F.col("n_total") != expected)).select("generator", "n_total")


def score_table(ratings: DataFrame) -> DataFrame:
    """Mean score by generator, judge, both and neither ("ALL", -1): valid scores from 1 to 5, best first."""
    scored = ratings.where(F.coalesce("output_valid", F.lit(True)) & F.col("score").between(1, 5))
    out = scored.cube("generator", "judge").agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"), F.count_distinct("run_id").alias("n_quizzes"),
        F.grouping("generator").alias("_all_generator"), F.grouping("judge").alias("_all_judge"),
    )
    every = F.when(F.col("_all_judge") == 1, -1).otherwise(F.col("judge"))
    named = out.select(margin("generator", "ALL").alias("generator"), every.alias("judge"), "mean_score", "n", "n_quizzes")
    return named.orderBy(F.desc("mean_score"), "generator", "judge")


def run_summaries(ratings: DataFrame) -> DataFrame:
    """A judge's summary of each run: items, valid responses, passes, mean score, and fail reasons with their numbers."""
    ok = F.coalesce(F.col("output_valid"), F.lit(False))
    keys = ["run_id", "generator", "judge"]
    counts = ratings.groupBy(*keys).agg(
        F.count("*").alias("n_items"), F.count_if(ok).alias("n_valid_responses"), F.count_if(ok & passes()).alias("n_pass"),
        F.avg(F.when(ok, F.col("score"))).alias("medical_score_mean"),
    )
    if "fail_reason" not in ratings.columns:
        return counts
    reasons = ratings.where(ok & F.col("fail_reason").isNotNull()).groupBy(*keys, "fail_reason").agg(F.count("*").alias("n"))
    merged = reasons.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fail_reason", "n")))).alias("fail_reasons"))
    return counts.join(merged, keys, "left")


def summary_rollup(summaries: DataFrame) -> DataFrame:
    """Sums over runs by generator and judge; the score mean is weighted by items that have one, a rate without items is 0."""
    valid = F.sum("n_valid_responses")
    scored = F.when(F.col("medical_score_mean").isNotNull() & (F.col("n_valid_responses") > 0), F.col("n_valid_responses"))
    rolled = summaries.groupBy("generator", "judge").agg(
        F.sum("n_items").alias("n_items"), valid.alias("n_valid"), F.sum("n_pass").alias("n_pass"),
        F.round(F.coalesce(F.try_divide(F.sum("n_pass").cast("double"), valid), F.lit(0.0)), 6).alias("pass_rate"),
        F.round(F.try_divide(F.sum(F.col("medical_score_mean") * scored), F.sum(scored)), 6).alias("score_mean"),
    )
    if "fail_reasons" not in summaries.columns:
        return rolled
    each = summaries.select("generator", "judge", F.explode("fail_reasons").alias("reason", "n"))
    sums = each.groupBy("generator", "judge", "reason").agg(F.sum("n").alias("n")).groupBy("generator", "judge")
    merged = sums.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("fail_reasons"))
    return rolled.join(merged, ["generator", "judge"], "left")


def ensemble(summaries: DataFrame) -> DataFrame:
    """Mean and spread over the rates of every run and judge with valid responses, by generator."""
    rates = summaries.where("n_valid_responses > 0").withColumn("r", F.col("n_pass") / F.col("n_valid_responses"))
    return rates.groupBy("generator").agg(
        F.round(F.avg("r"), 6).alias("pass_mean"), F.round(F.stddev_samp("r"), 6).alias("pass_std"),
        F.round(F.avg("medical_score_mean"), 6).alias("score_mean"), F.round(F.stddev_samp("medical_score_mean"), 6).alias("score_std"),
        F.count("medical_score_mean").alias("n_judge_evals"), F.count_distinct("run_id").alias("n_quizzes"),
    )


def rows_by_judge(selected: DataFrame, judges: Sequence, ratings: DataFrame) -> DataFrame:
    """A row for every selected question and judge: verdict and score, and whether the judge has a row for it.

    The judges are a short literal list.
    """
    listed = F.explode(F.array(*(F.lit(j) for j in judges)))
    own = ratings.select("run_id", "unit", "judge", "output_valid", "verdict", "score", F.lit(True).alias("_there"))
    joined = selected.withColumn("judge", listed).join(own, ["run_id", "unit", "judge"], "left")
    return joined.withColumn("has_judge_row", F.col("_there").isNotNull()).drop("_there")


def selection_sensitivity(selected: DataFrame, ratings: DataFrame, cutoffs: Sequence[int], base: int = 3) -> DataFrame:
    """Questions of a selection that stay at each score cutoff, by generator: n_selected, cutoff, n_kept.

    A question stays if the majority verdict accepts it and the cutoff keeps it.
    """
    logical = accepted_units(ratings, min_score=base)
    kept = accepted_by_cutoff(ratings, cutoffs, base).join(logical, ["run_id", "unit"], "left_semi")
    totals = selected.groupBy("generator").agg(F.count("*").alias("n_selected"))
    grid = totals.withColumn("cutoff", F.explode(F.array(*(F.lit(c) for c in cutoffs))))
    own = kept.join(selected, ["run_id", "unit"]).groupBy("generator", "cutoff").agg(F.count("*").alias("n_kept"))
    return grid.join(own, ["generator", "cutoff"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def vote_patterns(ratings: DataFrame, min_score: int | None = 1) -> DataFrame:
    """How many questions have which number of passing and of eligible votes: for finding out why nothing is accepted."""
    ok = eligible(min_score)
    votes = ratings.groupBy("run_id", "unit").agg(F.count_if(ok & passes()).alias("passed"), F.count_if(ok).alias("eligible"))
    return votes.groupBy("passed", "eligible").agg(F.count("*").alias("n_questions"))


def vote_status(ratings: DataFrame, min_score: int | None = 1) -> DataFrame:
    """Votes by what becomes of them: passed, failed, low_score, invalid_output."""
    valid = F.coalesce(F.col("output_valid"), F.lit(False))
    status = F.when(~valid, "invalid_output").when(~eligible(min_score), "low_score").when(passes(), "passed").otherwise("failed")
    return ratings.groupBy("generator", status.alias("status")).agg(F.count("*").alias("n_votes"))


def accepted_by_cutoff(ratings: DataFrame, cutoffs: Sequence[int], base: int = 3) -> DataFrame:
    """(cutoff, run_id, unit): more than half of the votes that score ``base`` or more score the cutoff or more.

    One scan serves all cutoffs: a unit's counts are made once and compared
    with each.
    """
    scored = F.coalesce(F.col("output_valid"), F.lit(False)) & (F.col("score") >= base)
    counts = ratings.groupBy("run_id", "unit").agg(
        F.count_if(scored).alias("n"),
        *(F.count_if(scored & (F.col("score") >= c)).alias(f"c{c}") for c in cutoffs),
    )
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"c{c}").alias("k")) for c in cutoffs)))
    long = counts.select("run_id", "unit", "n", pairs.alias("e"))
    return long.where(2 * F.col("e.k") > F.col("n")).select("e.cutoff", "run_id", "unit")


def kept_by_cutoff(ratings: DataFrame, cutoffs: Sequence[int], base: int = 3, verdicts_first: bool = True) -> DataFrame:
    """generator, cutoff, n_kept: questions kept at each score cutoff.

    With ``verdicts_first`` the majority verdict decides once and the cutoff
    narrows it (monotone in the cutoff); otherwise verdicts are counted anew
    among the votes that reach each cutoff (not monotone).
    """
    named = ratings.select("run_id", "unit", "generator").distinct()
    if verdicts_first:
        logical = accepted_units(ratings, min_score=base)
        kept = accepted_by_cutoff(ratings, cutoffs, base).join(logical, ["run_id", "unit"], "left_semi")
    else:
        ok = F.coalesce(F.col("output_valid"), F.lit(False))
        counts = ratings.groupBy("run_id", "unit").agg(
            *(F.count_if(ok & (F.col("score") >= c)).alias(f"n{c}") for c in cutoffs),
            *(F.count_if(ok & (F.col("score") >= c) & passes()).alias(f"p{c}") for c in cutoffs),
        )
        each = [F.struct(F.lit(c).alias("cutoff"), F.col(f"n{c}").alias("n"), F.col(f"p{c}").alias("p")) for c in cutoffs]
        long = counts.select("run_id", "unit", F.explode(F.array(*each)).alias("e"))
        kept = long.where("2 * e.p > e.n").select("e.cutoff", "run_id", "unit")
    return kept.join(named, ["run_id", "unit"]).groupBy("generator", "cutoff").agg(F.count("*").alias("n_kept"))


def availability(kept: DataFrame, totals: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """One row for each generator: its number of questions and those kept at each cutoff."""
    wide = kept.groupBy("generator").pivot("cutoff", list(cutoffs)).agg(F.first("n_kept"))
    wide = wide.select("generator", *(F.col(f"`{c}`").alias(f"kept_{c}") for c in cutoffs))
    filled = [F.coalesce(f"kept_{c}", F.lit(0)).alias(f"kept_{c}") for c in cutoffs]
    return totals.join(wide, "generator", "left").select("generator", "n_total", *filled)


def votes_to_score(ratings: DataFrame, min_pass: int, min_total: int) -> DataFrame:
    """Valid scored ratings of units with at least ``min_pass`` passing of ``min_total`` verdicts."""
    verdict = F.upper(F.trim("verdict")).isin("PASS", "FAIL") & F.coalesce(F.col("output_valid"), F.lit(True))
    gate = ratings.groupBy("run_id", "unit").agg(F.count_if(verdict).alias("n"), F.count_if(verdict & passes()).alias("p"))
    gate = gate.where((F.col("p") >= min_pass) & (F.col("n") >= min_total)).select("run_id", "unit")
    usable = F.coalesce(F.col("output_valid"), F.lit(True)) & F.col("score").between(1, 5)
    return ratings.where(usable).join(gate, ["run_id", "unit"], "left_semi")


def judge_status(ratings: DataFrame, judges: DataFrame) -> DataFrame:
    """status and n for each judge over units with any rating.

    ``judges`` (column judge) lists who was expected.  Status: verdict,
    missing_verdict, invalid_output or missing_row.  The expected judges are
    few and attached as one array, so units are not joined with judges.
    """
    expected = judges.agg(F.sort_array(F.collect_set("judge")).alias("expected"))
    status = (
        F.when(F.col("output_valid") == F.lit(False), "invalid_output")
        .when(F.upper(F.trim("verdict")).isin("PASS", "FAIL"), "verdict")
        .otherwise("missing_verdict")
    )
    seen = ratings.join(judges, "judge", "left_semi").select("judge", status.alias("status"), "run_id", "unit")
    counted = seen.groupBy("judge", "status").agg(F.count("*").alias("n"))
    units = ratings.select("run_id", "unit").distinct().agg(F.count("*").alias("units"))
    own = seen.select("judge", "run_id", "unit").distinct().groupBy("judge").agg(F.count("*").alias("own"))
    listed = expected.select(F.explode("expected").alias("judge")).join(own, "judge", "left")
    missing = listed.join(F.broadcast(units)).select(  # one row of one number
        "judge", F.lit("missing_row").alias("status"), (F.col("units") - F.coalesce("own", F.lit(0))).alias("n")
    )
    return counted.unionByName(missing.where("n > 0"))
