"""Corpus pipeline: five of the corpus operators, one after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  Between stages the rows are written as Parquet and read
again, so a lost executor never costs more than the stage that runs.  The
stages up to the last return the columns of ``documents``.

A stage begins by deleting the intermediate tables of the stage before it,
whose result has been written by then, so the disk holds those of one stage at
a time; ``run`` also deletes what a stage has returned once the next one has
been written.  Only tables of the pipeline are deleted, and ``run`` keeps its
own list: results of operators that others hold stay whole, also those of
another run.  What is left is what the last stage reads, one table of
documents, as its result is lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm import byte_bpe, decontamination, line_dedup, ngram_join, toxicity
from veridict.llm.tables import collected, delete_noted, forget, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score this much are rejected.
TOXIC = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The tables of the stage before, of the run that is going on; stages that are called one by one share a list.
_before: ContextVar[list[str]] = ContextVar("before", default=[])  # noqa: B039


def _stage(work: Stage) -> Stage:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _before.get()
        delete_noted(spark, paths)
        with collected(paths):
            return work(spark, docs, sf_dir)

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not call toxic; it learns from the labelled rows not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, machine).where(F.col("toxicity") < TOXIC).select(*COLUMNS)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; n_chars counts what is left."""
    done = line_dedup.dedup_lines(docs, removed="_removed")
    n_chars = F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*COLUMNS)


@_stage
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at a similarity of 0.8."""
    return ngram_join.keep_one(docs, size=5, percent=80).select(*COLUMNS)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document instead of its text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs.select(*COLUMNS), path, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]

#: A trained kernel machine can't be put in SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    token = _before.set([])
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = written(docs)
                if before is not None:
                    forget(before)
                before = docs
    finally:
        _before.reset(token)
    return docs
