"""Exact dedup by a stateful stream.

Documents arrive as thin rows (identifier, digest of the normalised text, place
of the content: file and row).  A streaming aggregation keeps, for every digest
ever seen, the first document's identifier and place and the number of copies,
in RocksDB under the checkpoint folder, without a watermark, so nothing
expires; later arrivals meet the same state.  Every hit is then checked by its
full bytes: rows of a digest with several copies are compared with the content
at the place that the state holds, and digests under which texts differ are
grouped by the texts themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.tables import join_frequent, join_salted, shared_folder, written

#: Bytes of thin rows that one micro-batch takes.
BATCH_BYTES = 64 << 30
#: Settings of the stream that keeps the state on disk, within a bound of memory for all stores of an executor,
#: and without files that are allocated before they are needed (megabytes for every store, however small).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Each run of blanks (0x20, 0x09-0x0D) as one space; null as empty.  Only runs that change are replaced."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(docs: DataFrame, key: str, text: str, digest=sha256) -> DataFrame:
    """Identifier, digest, content and its place.  ``docs`` must be read from files; its columns may have any names."""
    place = docs.metadataColumn("_metadata")
    rows = docs.select(docs[key].alias("id"), normalised(docs[text]).alias("content"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return rows.withColumn("digest", digest(F.col("content")))


def absorb(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, digest=sha256) -> None:
    """Add the documents, rows of Parquet files, to the state in ``folder``.

    ``folder`` holds the thin rows of all arrivals and the stream's checkpoint.
    Documents count as arrived once their thin rows are written; if the job
    ends between that and the state, ``catch_up`` goes on.
    """
    thin = _located(docs, key, text, digest).drop("content")
    thin.write.mode("append").parquet(f"{folder}/arrivals")
    catch_up(docs.sparkSession, folder, batch_bytes)


def catch_up(spark: SparkSession, folder: str, batch_bytes: int = BATCH_BYTES) -> None:
    """Take all arrivals that the state does not hold yet into it, each exactly once."""
    schema = spark.read.parquet(f"{folder}/arrivals").schema
    arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{folder}/arrivals")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "file", "row"))
    state = arrivals.groupBy("digest").agg(first.alias("first"), F.count("*").alias("copies"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        stream = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stream.awaitTermination()


def known(spark: SparkSession, folder: str) -> DataFrame:
    """The state: digest, ``first`` (struct of id, file, row) and number of ``copies``, read from the state store."""
    state = spark.read.format("statestore").load(f"{folder}/state")
    return state.select(F.col("key.digest").alias("digest"), F.col("value.min").alias("first"), F.col("value.count").alias("copies"))


def _members(contents: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows, with content, of all digests that have several copies."""
    return join_frequent(contents.drop("id"), groups.select("digest", "first", F.col("copies").alias("c")), "digest")


def _differing(members: DataFrame) -> DataFrame:
    """Digests under which some row's bytes are not those of the content at the stored place."""
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    firsts = members.where(is_first).select("digest", F.col("content").alias("stored"))
    hits = members.where(~is_first).select("digest", "content", "file", "row")
    pairs = join_salted(hits, firsts, ["digest"], members.select("digest"))
    return pairs.where("content <> stored").select("digest").distinct()


def decisions(contents: DataFrame, folder: str, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """One row for each document absorbed so far: id, keep_id, group_size, kept, digest.

    ``contents`` are the documents that were absorbed (of all arrivals).  Of
    equal texts the one with the smallest identifier stays, a null identifier
    counting as largest; rows that share it are told apart by their place, so
    exactly one row of a group stays.  Null texts equal empty ones; a text of
    blanks only is one space.  Nothing absorbed gives no rows.
    """
    spark = contents.sparkSession
    state = written(known(spark, folder))
    groups = state.where("copies > 1")
    members = written(_members(_located(contents, key, text, digest), groups))
    thin = spark.read.parquet(f"{folder}/arrivals")
    decided = join_frequent(thin, state.withColumn("c", F.col("copies")), "digest")
    differing = written(_differing(members))
    if not differing.isEmpty():
        clashing = members.drop("first").join(differing, "digest", "left_semi").join(thin.select("id", "file", "row"), ["file", "row"])
        first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "file", "row"))
        exact = clashing.groupBy("digest", "content").agg(first.alias("first_"), F.count("*").alias("copies_"))
        split = clashing.join(exact, ["digest", "content"]).select("file", "row", "first_", "copies_")
        decided = decided.join(split, ["file", "row"], "left").withColumns(
            {"first": F.coalesce("first_", "first"), "copies": F.coalesce("copies_", "copies")}
        )
    return decided.select(
        "id",
        F.col("first.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
        "digest",
    )


def dedup(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """``absorb`` and ``decisions`` for documents that arrive at once, with state in a new folder unless one is given."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    absorb(docs, folder, key, text, digest=digest)
    return decisions(docs, folder, key, text, digest)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its copies."""
    rows = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
