"""Shards by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one sorting task should get.
ROWS_A_BUCKET = 50_000


def _buckets(spark: SparkSession, rows: int) -> int:
    return max(1, -(-rows // ROWS_A_BUCKET))


def _ranked(df: DataFrame, stratum: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Append ``name``: the 0-based rank of a row in its stratum.

    ``bucket`` must rise with ``order``.  Rows are numbered within (stratum,
    bucket) and moved up by the number of rows in lower buckets, so that no
    task sorts a whole stratum.
    """
    key = [*stratum, bucket]
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*stratum).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    joined = df.withColumn("_inner", inner).join(starts, key)
    return joined.withColumn(name, F.col("_inner") - 1 + F.col("_start")).drop("_inner", "_start")


def interleave(
    docs: DataFrame, shards: int, source: str = "source", key: str = "doc_id", seed: int = 17
) -> DataFrame:
    """Append ``shard`` (0 to shards - 1), ``slot`` (from 0, gapless in a shard).

    Rows are shuffled by an md5 of seed, key and all columns within their source,
    placed at the fraction (rank + 1/2) / (rows of the source), sorted by
    fraction and cut into shards whose row counts differ by one at most; every
    stretch of the order, and so every shard, holds the sources in the corpus's
    proportions.  A null source is a source of its own.  Rows that agree in
    key, also null ones, are told apart by their other columns, of any type;
    rows that agree in all columns are interchangeable.  An empty table gives an empty result.
    Columns of ``docs`` named ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    rest = [F.col(c).cast("string") for c, kind in docs.dtypes if c != key and not kind.startswith(("map", "struct", "array", "variant"))]
    slim = docs.select(
        *(F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)),
        F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("_source"),
        F.col(key).alias("_key"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), *rest).cast("binary")).alias("_mix"),
    )
    rows = slim.select("_key").count()
    n = _buckets(spark, rows)
    high = F.conv(F.substring("_mix", 1, 8), 16, 10).cast("long")
    slim = slim.withColumn("_bucket", F.floor(high * n / (1 << 32)).cast("int"))
    # columns decide between rows of one key and mix, which a null and its neighbour's value may share
    ties = [F.to_json(F.struct(f"c_{i}")) if kind.startswith(("map", "variant")) else F.col(f"c_{i}") for i, (_, kind) in enumerate(docs.dtypes)]
    ranked = _ranked(slim, ["_source"], "_bucket", ["_mix", F.col("_key"), *ties], "_rank")
    totals = slim.groupBy("_source").agg(F.count("*").alias("_total"))
    placed = ranked.join(totals, "_source").withColumn(
        "_fraction", (2 * F.col("_rank") + 1) / (2.0 * F.col("_total"))
    )
    placed = placed.withColumn("_slice", F.floor(F.col("_fraction") * n).cast("int")).withColumn("_all", F.lit(0))
    order = [F.col("_fraction"), F.col("_source"), F.col("_mix"), F.col("_key"), *ties]
    final = _ranked(placed, ["_all"], "_slice", order, "_at")
    shard = F.floor(F.col("_at") * shards / F.lit(max(rows, 1))).cast("int")
    first = F.ceil(shard.cast("long") * F.lit(max(rows, 1)) / F.lit(shards)).cast("long")
    return final.select(
        *(F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)),
        shard.alias("shard"),
        (F.col("_at") - first).cast("long").alias("slot"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return interleave(slim, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
