"""Leaderboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(accuracy: DataFrame, cost: DataFrame, validity: DataFrame) -> DataFrame:
    """Models by falling accuracy (then name), with cost and validity where known, rank and top-three mark."""
    joined = accuracy.join(cost, "model", "left").join(validity, "model", "left")
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_acc"), F.lower("model"), "model"))
    return joined.withColumn("rank", rank).withColumn("medal", F.when(F.col("rank") <= 3, F.col("rank")))


def pareto_frontier(rows: DataFrame, cost: str = "cost", accuracy: str = "acc", eps: float = 1e-9) -> DataFrame:
    """Rows that beat every row of no greater cost; ties in cost go to the better accuracy, then the name."""
    over = Window.orderBy(cost, F.desc(accuracy), "model").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(accuracy).over(over)
    return rows.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(accuracy) > F.col("_best") + eps)).drop("_best")


def placed(rows: DataFrame, *order, by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Rows with their place (from 1) by ``order``, in groups of ``by``, at most ``most`` of each; give an order without ties.

    For report tables, which are small; a limit by place is cut before the
    shuffle.
    """
    over = Window.partitionBy(*by).orderBy(*order)
    found = rows.withColumn("place", F.row_number().over(over))
    return found if most is None else found.where(F.col("place") <= most)


def provider(model, use_batch: bool):
    """Which transport serves a model: sequential without batches, anthropic by the name's beginning, else openai."""
    if not use_batch:
        return F.lit("sequential")
    return F.when(F.startswith(model, F.lit("claude-")), "anthropic").otherwise("openai")


def next_request(plan: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """category, ask, advance, left: how many to ask for (need, valid): more than is needed, and what a round has yielded."""
    done = F.least("valid", "need")
    return plan.select("category", F.ceil(F.col("need") * multiplier).alias("ask"), done.alias("advance"), (F.col("need") - done).alias("left"))


def plan_errors(plan: DataFrame, counts: DataFrame) -> DataFrame:
    """Categories whose number in a plan (a row a question) is not the one asked for (category, n)."""
    own = plan.groupBy("category").agg(F.count("*").alias("planned"))
    both = own.join(counts, "category", "full_outer")
    both = both.select("category", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("n", F.lit(0)).alias("asked"))
    return both.where("planned <> asked")
