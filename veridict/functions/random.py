"""Random numbers that depend only on a seed, a replicate and an item.

Every item has two keys, 31 bits each of the md5 of its identifier, and every
replicate a polynomial over them, modulo a prime, whose coefficients come from
the md5 of seed and replicate.  For one pair of items, over all polynomials,
the draws are independent.  Nothing depends on partitioning or order, and the
same arithmetic can be written in SQL (products stay below 2^63).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The prime below which all draws lie.
P = 2**31 - 1
#: floor(P * P(X <= k)) of the Poisson distribution of mean 1, for k = 0, 1, ...
POISSON = (
    790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887, 2147461637, 2147481230, 2147483407,
    2147483625, 2147483645,
)
_COEFFICIENTS = ("ca", "cb", "cc", "cd")


def _bits(text: Column, place: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), place, 8), 16, 10).cast("long") % P


def item_keys(*columns: str) -> list[Column]:
    """Columns ``k1`` and ``k2`` of an item that the columns identify; null counts as a value."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    return [_bits(text, 1).alias("k1"), _bits(text, 9).alias("k2")]


def replicates(spark: SparkSession, iterations: int, seed: int = 0) -> DataFrame:
    """replicate and its coefficients, ``iterations`` rows."""
    rows = spark.range(iterations).withColumnRenamed("id", "replicate")
    text = lambda name: F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.lit(name))
    return rows.select("replicate", *(_bits(text(c), 1).alias(c) for c in _COEFFICIENTS))


def drawn(items: DataFrame, identify: list[str], iterations: int, seed: int = 0, name: str = "z") -> DataFrame:
    """Every item once in every replicate, with a draw from 0 to P - 1.

    Rows are multiplied where they lie; the coefficients are a broadcast table
    of as many rows as there are replicates.
    """
    each = items.select("*", *item_keys(*identify)).withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    each = each.join(F.broadcast(replicates(items.sparkSession, iterations, seed)), "replicate")
    first = (F.col("ca") * F.col("k1") + F.col("cb")) % P
    second = (first * F.col("k1") + F.col("cc") * F.col("k2") + F.col("cd")) % P
    return each.withColumn(name, second).drop("k1", "k2", *_COEFFICIENTS)


def poisson(z: str) -> Column:
    """The Poisson variable of mean 1 that belongs to a draw: how often the item is taken."""
    out = F.when(F.col(z) < POISSON[0], 0)
    for k, limit in enumerate(POISSON[1:], 1):
        out = out.when(F.col(z) < limit, k)
    return out.otherwise(len(POISSON))


def sql_bits(text: str, place: int = 1) -> str:
    """DuckDB counterpart of the 31 bits of a text."""
    return f"(('0x' || substr(md5({text}), {place}, 8))::BIGINT % {P})"


def sql_replicates(iterations: int, seed: int = 0) -> str:
    """DuckDB counterpart of ``replicates``, as a common table expression."""
    columns = ", ".join(f"{sql_bits(f"'{seed}|' || b || '|{c}'")} AS {c}" for c in _COEFFICIENTS)
    return f"replicates AS (SELECT b AS replicate, {columns} FROM range({iterations}) r(b))"


#: DuckDB counterparts of a draw, over k1, k2 and the coefficients, and of the Poisson variable of a draw z.
SQL_DRAW = f"((((ca * k1 + cb) % {P}) * k1 + cc * k2 + cd) % {P})"
SQL_POISSON = "CASE " + " ".join(f"WHEN z < {limit} THEN {k}" for k, limit in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
