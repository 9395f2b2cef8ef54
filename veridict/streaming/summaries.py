"""Accuracy by model, kept up to date as answer summaries arrive.

New summary files are found by Spark's file source; each is read once.  The
state is a few sums for each generator and model, so it does not grow with the
number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict import schemas


def answer_summary_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of answer summaries below ``root`` with run_dir and generator; judge summaries and other files are left out."""
    reader = spark.readStream.schema(schemas.ANSWER_SUMMARY).option("multiLine", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*_summary.json").option("maxFilesPerTrigger", files_per_batch).json(root)
    path = F.col("_metadata.file_path")
    named = rows.select("*", path.alias("file_path")).where(~F.col("file_path").endswith("_judge_summary.json") & F.col("model").isNotNull())
    return named.withColumns(
        {
            "run_dir": F.regexp_replace("file_path", "/[^/]*$", ""),
            "generator": F.try_element_at(F.split("file_path", "/"), F.lit(-3)),
            "acc": F.coalesce("acc", F.lit(0.0)),
        }
    )


def running_accuracy(summaries: DataFrame) -> DataFrame:
    """Mean, standard error and number of runs by generator and model, over all that has arrived."""
    return summaries.groupBy("generator", "model").agg(
        F.avg("acc").alias("mean_acc"), (F.stddev_samp("acc") / F.sqrt(F.count("acc"))).alias("sem"), F.count("*").alias("n_quizzes")
    )


def write_available(running: DataFrame, path: str, checkpoint: str) -> None:
    """Work through what is there, replacing the table at ``path`` after each batch, and stop.

    A restart from the same checkpoint reads only new files.
    """

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = running.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
