"""Quota subsets, interleaving and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_quota(candidates: DataFrame, targets: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The first ``target`` candidates of each category by ``order``, with their place (rn, from 1).

    ``targets`` has category, target and ord (the category's place).  Only
    (keys, category) groups are ranked; give an order that ends in a unique
    column.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, "category").orderBy(*order))
    ranked = candidates.join(targets, "category").withColumn("rn", rank)
    return ranked.where("rn <= target").drop("target")


def shortfall(candidates: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """Categories with fewer candidates than their target, with what is missing."""
    groups = candidates.select(*keys).distinct() if keys else None
    # the targets are a short list of categories: they travel as one array
    every = targets.agg(F.collect_list(F.struct(*targets.columns)).alias("_t"))
    wanted = targets if groups is None else groups.join(F.broadcast(every), how="cross").select(*keys, F.inline("_t"))
    have = candidates.groupBy(*keys, "category").agg(F.count("*").alias("n"))
    both = wanted.join(have, [*keys, "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.where("n < target").select(*keys, "category", "target", "n", (F.col("target") - F.col("n")).alias("missing"))


def interleave(selected: DataFrame, *keys: str) -> DataFrame:
    """Append ``index`` (from 0): round-robin over categories in the order ``ord``, each in its own order ``rn``."""
    over = Window.partitionBy(*keys).orderBy("rn", "ord")
    return selected.withColumn("index", F.row_number().over(over) - 1)


def chunk(indexed: DataFrame, size: int, prefix: str = "part") -> DataFrame:
    """Append chunk (from 0), place (from 1) and an id for each row of an interleaved selection."""
    c, place = F.floor(F.col("index") / size).cast("int"), (F.col("index") % size + 1).cast("int")
    return indexed.withColumns({"chunk": c, "place": place, "chunk_id": F.format_string(f"{prefix}-p%02d-%03d", c, place)})


def expand(targets: DataFrame) -> DataFrame:
    """A row for each wanted question: category repeated target times, numbered in the order of categories."""
    before = F.coalesce(F.sum("target").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = targets.withColumn("before", before).where("target > 0")
    return rows.select("category", F.explode(F.sequence(F.lit(0), F.col("target") - 1)).alias("k"), "before").select(
        (F.col("before") + F.col("k")).alias("position"), "category"
    )


def repeat_plan(plan: DataFrame, length: int) -> DataFrame:
    """place (from 0), category: a plan repeated from its beginning until it has ``length`` places; an empty plan stays empty."""
    size = plan.agg(F.count("*").cast("int").alias("_size"))
    sized = plan.join(F.broadcast(size), how="cross")  # one row of one number
    places = F.expr(f"explode(sequence(place, greatest({length} - 1, place), _size))")
    return sized.select(places.alias("place"), "category").where(F.col("place") < length)


def first_by_priority(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``, by an aggregation that combines map-side."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in [*order, *rest])).select(*rows.columns)
