"""Bootstrap and permutation by draws that depend only on a counter.

A replicate is one value of a column: every item meets every replicate where it
lies, draws from (seed, replicate, item), and only sums by replicate are
shuffled.  Items are taken as often as a Poisson variable of mean 1 says, the
form of the bootstrap that needs no total: in a replicate about as many items
are drawn as there are.  Nothing of the items passes the driver, no result
depends on partitioning, and SQL gives the same numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.functions.random import POISSON, P, drawn, item_keys, poisson, replicates
from veridict.functions.special import binomial_quantile
from veridict.operators.reliability import nominal as differ

#: Rows that one sorting task should get.
ROWS_A_BUCKET = 50_000
#: Items of a stratum that a task holds as arrays (a larger one is ranked as rows), and the shares its replicates are dealt to.
ITEMS_HELD, SHARES = 1_000_000, 8


def paired_bootstrap(attempts: DataFrame, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """replicate, llm, mean: resampled means of items that every llm has tried, all llms on the same draw.

    There are as many columns as llms while sums are made.  No rows where no
    item has been tried by all; a replicate that draws nothing has no rows.
    """
    wide = attempts.groupBy("item").pivot("llm").agg(F.max("y")).dropna()
    kind = dict(attempts.dtypes)["llm"]
    names = [c for c in wide.columns if c != "item"]
    taken = drawn(wide, ["item"], iterations, seed).withColumn("w", poisson("z"))
    sums = taken.groupBy("replicate").agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(f"`{c}`")).alias(f"s{k}") for k, c in enumerate(names)))
    each = F.array(*(F.struct(F.lit(c).cast(kind).alias("llm"), (F.col(f"s{k}") / F.col("n")).alias("mean")) for k, c in enumerate(names)))
    if not names:
        return attempts.sparkSession.createDataFrame([], f"replicate long, llm {kind}, mean double")
    return sums.where("n > 0").select("replicate", F.explode(each).alias("e")).select("replicate", "e.*")


def percentile_interval(replicates: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median and 95 % percentile interval by linear interpolation."""
    at = lambda q: F.round(F.percentile(value, q), 6)
    return replicates.groupBy(*keys).agg(at(0.5).alias("median"), at(0.025).alias("low"), at(0.975).alias("high"))


def pairwise_differences(replicates: DataFrame, delta: float = 0.02) -> DataFrame:
    """Every two llms' difference: interval, and whether it lies within plus or minus delta."""
    each = replicates.groupBy("replicate").agg(F.sort_array(F.collect_list(F.struct("llm", "mean"))).alias("m"))
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.llm as a, y.llm as b, x.mean - y.mean as d))))")
    long = each.select("replicate", F.explode(pairs).alias("e")).select("replicate", "e.*")
    spread = percentile_interval(long, "d", "a", "b")
    return spread.withColumn("within_delta", (F.col("low") > -delta) & (F.col("high") < delta))


#: Draws that a task makes at once, few enough for a cache.
DRAWS = 1 << 16


def _coefficients(spark: SparkSession, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Replicates and their coefficients, the table that ``drawn`` broadcasts."""
    rows = replicates(spark, iterations, seed).orderBy("replicate").collect()
    names = np.array([r["replicate"] for r in rows], dtype=np.int64)
    return names, np.array([[r[c] for r in rows] for c in ("ca", "cb", "cc", "cd")], dtype=np.int64).reshape(4, -1, 1)


def _weighted(units: DataFrame, kind: str, iterations: int, seed: int) -> DataFrame:
    """replicate, v, m, o: a task's sums over its units of w * c and w * o of their parts, where w is how often a unit is taken.

    ``units`` has k1, k2 and parts (v, c, o).  A task holds one number for
    every replicate and value, and draws for a bounded number of units at once.
    """
    names, coefficients = _coefficients(units.sparkSession, iterations, seed)
    limits = np.array(POISSON, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: dict = defaultdict(lambda: np.zeros(len(names)))
        o: dict = defaultdict(lambda: np.zeros(len(names)))
        type_v = pa.string()
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")]
            parts = batch.column("parts")
            start, flat = parts.offsets.to_numpy(), parts.values
            values, (c, d) = flat.field("v"), (flat.field(x).to_numpy(zero_copy_only=False) for x in ("c", "o"))
            type_v, coded = values.type, values.dictionary_encode()
            code, step = coded.indices.to_numpy(zero_copy_only=False), max(1, DRAWS // max(1, len(names)))
            distinct = coded.dictionary.to_pylist()
            for at in range(0, batch.num_rows, step):
                to = min(at + step, batch.num_rows)
                w = _taken(coefficients, keys[0][at:to], keys[1][at:to], limits)
                low, high = start[at], start[to]
                owner = np.repeat(np.arange(to - at), np.diff(start[at : to + 1]))
                dense = np.zeros((to - at, 2 * len(distinct)))
                np.add.at(dense, (owner, code[low:high]), c[low:high])
                np.add.at(dense, (owner, code[low:high] + len(distinct)), d[low:high])
                total = w @ dense
                for k, v in enumerate(distinct):
                    m[v] += total[:, k]
                    o[v] += total[:, k + len(distinct)]
        for v in m:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([v] * len(names), type_v), pa.array(m[v]), pa.array(o[v])], names=["replicate", "v", "m", "o"])

    # units are few bytes and much work: dealt by number, else adaptive execution puts them into few tasks
    tasks = 4 * units.sparkSession.sparkContext.defaultParallelism
    return units.repartition(tasks).mapInArrow(run, f"replicate bigint, v {kind}, m double, o double")


def _draws(coefficients: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Each unit's draw in each replicate: ``drawn`` on arrays."""

    def fold(x: np.ndarray) -> np.ndarray:
        """Equal modulo P = 2^31 - 1 and below 2^32, for x below 2^63; in place."""
        high = x >> 31
        x &= P
        x += high
        return x

    ca, cb, cc, cd = coefficients
    z = fold(fold(ca * k1 + cb) * k1)
    z += fold(cc * k2 + cd)
    z = fold(z)
    z -= P * (z >= P)
    return z.astype(np.int32)


def _taken(coefficients: np.ndarray, k1: np.ndarray, k2: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How often each unit is taken in each replicate: ``drawn`` and ``poisson`` on arrays."""
    z = _draws(coefficients, k1, k2)
    w = np.zeros(z.shape, dtype=np.uint8)
    for limit in limits:
        w += (z >= limit).view(np.uint8)
    return w.astype(np.float64)


def alpha_bootstrap(ratings: DataFrame, value: str, distance: Callable[[Column, Column], Column] = differ, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """replicate, alpha: Krippendorff's alpha over resampled units, 1 where no disagreement is expected.

    A unit's disagreement is dealt to its values, so that one sum by replicate
    and value gives both the margins and the observed disagreement.
    """
    counts = ratings.where(F.col(value).isNotNull()).groupBy("unit", F.col(value).alias("v")).agg(F.count("*").alias("c"))
    units = counts.groupBy("unit").agg(F.sum("c").alias("n"), F.collect_list(F.struct("v", "c")).alias("vs")).where("n > 1")
    dealt = F.transform("vs", lambda x: F.struct(
        x["v"].alias("v"), x["c"].alias("c"),
        (F.aggregate("vs", F.lit(0.0), lambda s, y: s + x["c"] * y["c"] * distance(x["v"], y["v"])) / (F.col("n") - 1)).alias("o"),
    ))
    # units whose values are the same add up alike, whatever they are called: a task needs one column of weights for each kind
    flat = units.select(F.col("unit"), dealt.alias("parts")).select(*item_keys("unit"), F.sort_array("parts").alias("parts"))
    sums = _weighted(flat, dict(ratings.dtypes)[value], iterations, seed)
    margins = sums.groupBy("replicate", "v").agg(F.sum("m").alias("m"), F.sum("o").alias("o")).where("m > 0")
    total = margins.groupBy("replicate").agg(F.sum("m").alias("n"), F.sum("o").alias("o"), F.collect_list(F.struct("v", "m")).alias("ms"))
    expected = F.aggregate("ms", F.lit(0.0), lambda s, x: s + F.aggregate("ms", F.lit(0.0), lambda t, y: t + x["m"] * y["m"] * distance(x["v"], y["v"])))
    alpha = 1 - F.try_divide(F.col("o") / F.col("n"), expected / (F.col("n") * (F.col("n") - 1)))
    return total.select("replicate", F.coalesce(alpha, F.lit(1.0)).alias("alpha"))


def proportion_interval(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """Per key: the ends between which resampled shares lie, from the binomial distribution itself; ``counts`` has key, c and n.

    Without trials there is no interval.
    """
    share = F.col("c") / F.nullif(F.col("n"), F.lit(0))
    end = lambda q: binomial_quantile(q, F.col("n"), share) / F.col("n")
    tail = (1 - level) / 2
    return counts.select("key", "c", "n", *(F.when(F.col("n") > 0, end(q)).alias(name) for name, q in (("low", tail), ("high", 1 - tail))))


def proportion_bootstrap(counts: DataFrame, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """Per key: 95 % interval of binomially resampled shares; ``counts`` has key, c and n.

    A replicate's draw is a uniform number, turned into the binomial variable
    of its quantile; with ever more replicates the ends are those of
    ``proportion_interval``.
    """
    # a draw becomes a share by the exact distribution, which keeps order: so it is enough to turn the ends of the draws
    draws = drawn(counts.where("n > 0"), ["key"], iterations, seed)
    ends = draws.groupBy("key", "c", "n").agg(*(F.percentile(F.col("z") / P, q).alias(f"u{k}") for k, q in enumerate((0.025, 0.975))))
    at = lambda u: binomial_quantile(F.col(u), F.col("n"), F.col("c") / F.col("n")) / F.col("n")
    return ends.select("key", at("u0").alias("low"), at("u1").alias("high"))


def _ranked(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """Append ``name``, the place from 1 by ``order``, whose first column is a draw.

    A group of many rows is cut into buckets of the draw's range, ranked apart
    and moved up by the rows in lower buckets, so no task sorts a large group.
    """
    largest = rows.where("replicate = 0").groupBy(*within).count().agg(F.max("count")).first()[0] or 1
    buckets = -(-largest // ROWS_A_BUCKET)
    if buckets == 1:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    rows = rows.withColumn("_bucket", F.floor(F.col(order[0]) * buckets / P))
    sizes = rows.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    lower = F.sum("_n").over(Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*within, "_bucket", F.coalesce(lower, F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order))
    return rows.withColumn("_inner", inner).join(starts, [*within, "_bucket"]).withColumn(name, F.col("_inner") + F.col("_start")).drop("_inner", "_start", "_bucket")


def _dealt_in_tasks(rows: DataFrame, iterations: int, seed: int) -> DataFrame:
    """replicate, stratum, part, total: sums of the values that a permutation within strata deals to each part of a stratum.

    ``rows`` has stratum, item, value and part (0, 1, ... in the order in which
    parts take ranks).  A task holds one stratum and sorts its draws, a
    replicate at a time; an item is moved once for each of SHARES shares of the
    replicates, not once a replicate.
    """
    names, coefficients = _coefficients(rows.sparkSession, iterations, seed)

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        order = pc.sort_indices(held, sort_keys=[("item", "ascending")], null_placement="at_start")  # decides between equal draws
        own = held.select(["k1", "k2", "value", "part"]).take(order)
        k1, k2, value, part = (own.column(c).to_numpy() for c in own.column_names)
        starts, place = np.cumsum(counts := np.bincount(part)) - counts, np.arange(len(k1))
        mine = np.flatnonzero(names % SHARES == key[1].as_py())
        out = np.zeros((len(mine), len(counts)))
        for i, r in enumerate(mine):
            ranked = np.sort((_draws(coefficients[:, r], k1, k2).astype(np.int64) << 32) + place) & 0xFFFFFFFF
            out[i] = np.add.reduceat(value[ranked], starts)
        return pa.table({
            "replicate": np.repeat(names[mine], len(counts)), "stratum": pa.array([key[0].as_py()] * out.size, pa.string()),
            "part": np.tile(np.arange(len(counts)), len(mine)), "total": out.ravel(),
        })

    slim = rows.select("stratum", "item", *item_keys("item"), F.coalesce("value", F.lit(0.0)).alias("value"), F.col("part").cast("long").alias("part"))
    # few bytes and much work: dealt by number, else adaptive execution puts them into few tasks
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism
    each = slim.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(tasks, "stratum", "share")
    return each.groupBy("stratum", "share").applyInArrow(run, "replicate bigint, stratum string, part bigint, total double")


def _dealt_as_rows(rows: DataFrame, cells: DataFrame, iterations: int, seed: int) -> DataFrame:
    """What ``_dealt_in_tasks`` returns, for strata of any size: every item is a row in every replicate."""
    ends = cells.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("end", "part"))).alias("ends"))  # a topic each
    ranked = _ranked(drawn(rows, ["item"], iterations, seed).drop("part"), ["replicate", "stratum"], ["z", "item"], "place")
    dealt = ranked.join(ends, "stratum").withColumn("part", F.filter("ends", lambda e: e["end"] >= F.col("place"))[0]["part"])
    return dealt.groupBy("replicate", "stratum", F.col("part").cast("long").alias("part")).agg(F.sum("value").alias("total"))


def topic_permutation(items: DataFrame, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """F of the one-way analysis of item values by topic, and p by permuting topics within strata.

    ``items`` has item, value, topic and stratum.  p = (1 + permutations with
    at least the observed F) / (1 + permutations).  A permutation ranks a
    stratum's items by their draws and deals the ranks to its topics, each as
    many as it has items; a null stratum is one of its own.  Strata of up to
    ITEMS_HELD items are ranked as arrays inside tasks, larger ones as rows.
    """
    slim = items.select("item", F.col("value").cast("double").alias("value"), "topic", F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("stratum"))
    cells = slim.groupBy("stratum", "topic").agg(F.count("*").alias("c"))
    along = Window.partitionBy("stratum").orderBy("topic")
    cells = cells.withColumns({"end": F.sum("c").over(along), "part": F.row_number().over(along) - 1, "n": F.sum("c").over(Window.partitionBy("stratum"))})
    known = cells.withColumnsRenamed({"stratum": "_stratum", "topic": "_topic"})
    same = (F.col("stratum") == F.col("_stratum")) & F.col("topic").eqNullSafe(F.col("_topic"))
    placed = slim.join(known.select("_stratum", "_topic", "part", "n"), same).select("stratum", "item", "value", "part", "n")
    large = F.col("n") > ITEMS_HELD
    dealt = _dealt_in_tasks(placed.where(~large), iterations, seed)
    if not cells.where(large).isEmpty():
        dealt = dealt.unionByName(_dealt_as_rows(placed.where(large).drop("n"), cells.where(large), iterations, seed))
    named = dealt.join(cells.select("stratum", "part", "topic"), ["stratum", "part"])
    sums = slim.groupBy("topic").agg(F.count("*").alias("size"), F.sum("value").alias("t"), F.sum(F.col("value") * F.col("value")).alias("q"))
    totals = named.groupBy("replicate", "topic").agg(F.sum("total").alias("total")).join(sums.select("topic", "size"), "topic")
    inner = totals.groupBy("replicate").agg(F.sum(F.col("total") * F.col("total") / F.col("size")).alias("inner"))
    whole = sums.agg(
        F.count("*").alias("k"), F.sum("size").alias("n"), F.sum("t").alias("grand"), F.sum("q").alias("squares"),
        F.sum(F.col("t") * F.col("t") / F.col("size")).alias("least"),
    )
    # F grows with the sum between topics; sums of the same numbers in another order may differ in the last digits
    reached = F.col("inner") >= F.col("least") - 1e-9 * F.greatest(F.lit(1.0), F.abs("least"))
    hits = inner.join(F.broadcast(whole.select("least"))).agg(F.count_if(reached).alias("h"))  # one row of sums
    between = F.col("least") - F.try_divide(F.col("grand") * F.col("grand"), F.col("n"))
    f = F.try_divide(between / F.nullif(F.col("k") - 1, F.lit(0)), (F.col("squares") - F.col("least")) / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    f = F.when(F.col("squares") > F.col("least"), f)
    defined = F.when(f.isNotNull(), F.col("h")).otherwise(0)
    return whole.join(F.broadcast(hits)).select(F.round(f, 6).alias("f"), F.round((1 + defined) / F.lit(1.0 + iterations), 6).alias("p_perm"))


def topic_bootstrap(items: DataFrame, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """topic, n_items, mean, low, high of the items' mean by topic, resampled within topics; the row "RANGE" is the
    difference between the greatest and the least topic mean, and its n_items the number of topics.

    ``items`` has item, topic and value; rows without a value are left out.  A
    topic has no mean in a replicate that draws none of its items.
    """
    usable = items.where("value is not null").select("item", "topic", F.col("value").cast("double").alias("value"))
    each = usable.groupBy("topic").agg(F.count("*").alias("n_items"), F.avg("value").alias("mean"))
    taken = drawn(usable, ["topic", "item"], iterations, seed).withColumn("w", poisson("z"))
    means = taken.groupBy("topic", "replicate").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("drawn"))
    ends = [F.percentile("drawn", q).alias(name) for name, q in (("low", 0.025), ("high", 0.975))]
    own = each.join(means.groupBy("topic").agg(*ends), "topic")
    spans = means.groupBy("replicate").agg((F.max("drawn") - F.min("drawn")).alias("drawn")).agg(*ends)
    whole = each.agg(F.count("*").alias("n_items"), (F.max("mean") - F.min("mean")).alias("mean")).join(F.broadcast(spans), how="cross")  # two rows of numbers
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "low", "high")]
    return own.select("topic", "n_items", *rounded).unionByName(whole.select(F.lit("RANGE").alias("topic"), "n_items", *rounded))
