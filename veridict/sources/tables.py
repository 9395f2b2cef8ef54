"""The driver's tables seen as ratings, attempts, answers and topic labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER = ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of order lines that a task sorts; a session's own number of tasks holds where it gives fewer each.
ROWS = 150_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a key over as many tasks as their number needs, so that what a task holds does not grow with the table."""
    parts = -(-rows.count() // ROWS)  # Parquet's own counts, nothing is read
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def lines(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """lineitem with one row for each key: the least in a total order, by an aggregation that combines map-side.

    Large tables are dealt out by the first key beforehand, which the joins
    and groupings that follow go by, too.
    """
    keys = keys or ("l_orderkey", "l_linenumber")
    rest = [c for c in (*_ORDER, "l_orderkey", "l_linenumber") if c not in keys]
    line = dealt(table(spark, sf_dir, "lineitem").select(*keys, *rest), keys[0])
    kept = line.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    return kept.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, unit, judge, generator, verdict, score, output_valid; one row for each unit and judge."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return (
        lines(spark, sf_dir)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws("/", "o_orderpriority", (F.col("l_orderkey") % 40).cast("string")).alias("run_id"),
            F.col("l_orderkey").alias("unit"),
            F.col("l_linenumber").cast("int").alias("judge"),
            F.col("o_orderpriority").alias("generator"),
            F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("verdict"),
            (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("score"),
            (F.col("l_suppkey") % 10 != 0).alias("output_valid"),
        )
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, llm, quiz, topic, y; one row for each item and answering model."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (
        lines(spark, sf_dir, "l_partkey", "l_linenumber")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_partkey").alias("item"),
            F.col("l_linenumber").cast("int").alias("llm"),
            F.col("p_brand").alias("quiz"),
            F.col("p_type").alias("topic"),
            (F.col("l_linestatus") == "F").cast("int").alias("y"),
        )
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, generator, unit, model, gold, pred (null where unanswered); one row for each unit and model."""
    line = lines(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    letter = lambda n: F.char(65 + n)
    gold = F.col("l_orderkey") % 5
    pred = F.when(F.col("l_suppkey") % 17 == 0, None).when(F.col("l_linestatus") == "F", gold).otherwise((gold + 1) % 5)
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("/", "o_orderpriority", (F.col("l_orderkey") % 40).cast("string")).alias("run_id"),
        F.col("o_orderpriority").alias("generator"),
        F.col("l_orderkey").alias("unit"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        letter(gold).alias("gold"),
        F.when(pred.isNotNull(), letter(pred)).alias("pred"),
    )


def part_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, generator, topic: a topic label of every part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("generator"), F.col("p_type").alias("topic"), "p_size"
    )


#: DuckDB counterparts of the adapters, as common table expressions.
SQL_LINES = """line AS (
    SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
        l_shipdate, l_extendedprice, l_quantity, l_returnflag, l_linestatus) = 1)"""
SQL_RATINGS = f"""{SQL_LINES}, ratings AS (
    SELECT o_orderpriority || '/' || (l_orderkey % 40) AS run_id, l_orderkey AS unit, l_linenumber::INT AS judge,
           o_orderpriority AS generator, CASE WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'PASS' END AS verdict,
           (1 + floor((l_quantity - 1) / 10))::INT AS score, l_suppkey % 10 <> 0 AS output_valid
    FROM line JOIN orders ON l_orderkey = o_orderkey)"""
SQL_ANSWERS = """answers AS (
    SELECT o_orderpriority || '/' || (l_orderkey % 40) AS run_id, o_orderpriority AS generator, l_orderkey AS unit,
           'm' || l_linenumber AS model, chr((65 + l_orderkey % 5)::INT) AS gold,
           CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_linestatus = 'F' THEN chr((65 + l_orderkey % 5)::INT)
                ELSE chr((65 + (l_orderkey + 1) % 5)::INT) END AS pred
    FROM line JOIN orders ON l_orderkey = o_orderkey)"""
SQL_ATTEMPTS = """item_line AS (
    SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_suppkey,
        l_shipdate, l_extendedprice, l_quantity, l_returnflag, l_linestatus, l_orderkey) = 1),
attempts AS (
    SELECT l_partkey AS item, l_linenumber::INT AS llm, p_brand AS quiz, p_type AS topic, (l_linestatus = 'F')::INT AS y
    FROM item_line JOIN part ON l_partkey = p_partkey)"""
