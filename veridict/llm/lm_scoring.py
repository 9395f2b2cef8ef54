"""Cross-entropy difference of documents under two matched n-gram models.

Both models are byte n-gram models of one order over one vocabulary (the 256
bytes), smoothed alike: an n-gram's probability is its share among the n-grams
with the same history, interpolated with the byte's share among all bytes, and
that with the uniform distribution.  The target model counts the documents of
a given set, the background model all documents; the background's counts are
scaled to the size of the target, so that neither model knows more histories
well than the other only because it has seen more text.  A document scores the
mean over its bytes of target loss minus background loss; lower is closer to
the target.

A document's own counts are taken out of both models before it is scored, so
that a member of the target is judged by the others and scores like a document
of the same kind that is no member.

Counts are exact and cover every document.  Documents are dealt into blocks by
a hash of their id; a block sends the distinct n-grams it holds with their
counts, the counts meet by history, and each block gets back the counts of
just the n-grams it has.  So what moves is a row for each distinct n-gram of a
block, twice, whatever the size of the model, and nothing is broadcast.  A
frequent n-gram comes once from a block, as do all others of it, so it holds
no more than a small share of the rows however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.tables import frequent, written
from veridict.llm.words import chunks, text_buffer

ORDER = 5
VOCABULARY = 256
#: Weight of the lower-order distribution, in counts.
SMOOTHING = 1.0
BLOCK_BYTES = 12 << 20
_CHUNK = 1 << 20


def grams(column: pa.Array, order: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the first text, size of each text, text, n-gram, count) by chunks of texts, sorted by text and n-gram.

    Every byte of a text ends one n-gram, an integer of ``order`` bytes; the
    history of the first bytes is filled up with zero bytes.  Orders up to 7.
    """
    raw, bounds = text_buffer(column)
    most = 1 << (62 - 8 * order)  # texts whose number fits beside an n-gram
    for first, last in chunks(bounds, _CHUNK):
        for a in range(first, last, most):
            b = min(a + most, last)
            cuts = bounds[a : b + 1] - bounds[a]
            buf = raw[bounds[a] : bounds[b]].astype(np.int64)
            owner = np.repeat(np.arange(b - a), np.diff(cuts))
            place = np.arange(len(buf)) - cuts[owner]
            key = buf | owner << (8 * order)
            for back in range(1, order):
                key[back:] |= np.where(place[back:] >= back, buf[:-back], 0) << (8 * back)
            key.sort()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            number = np.diff(np.concatenate([starts, [len(key)]]))
            key = key[starts]
            yield a, np.diff(cuts), key >> (8 * order), key & ((1 << (8 * order)) - 1), number


def _in_target(texts: pa.Table, ids: pa.ChunkedArray) -> np.ndarray:
    own = texts.column("doc_id")
    return np.asarray(pa.compute.and_(pa.compute.is_in(own, value_set=ids.combine_chunks()), own.is_valid()).to_numpy(), dtype=bool)


def _count(docs: DataFrame, ids: DataFrame, order: int) -> DataFrame:
    """(gram, block, n, n_target): each block's distinct n-grams."""

    def run(key: tuple, texts: pa.Table, ids: pa.Table) -> pa.Table:
        target = _in_target(texts, ids.column("doc_id"))
        parts = [(np.zeros(0, np.int64),) * 3]
        for first, _, owner, gram, n in grams(texts.column("text"), order):
            unique, at = np.unique(gram, return_inverse=True)
            own = n * target[first + owner]
            parts.append((unique, *(np.bincount(at, c, len(unique)).astype(np.int64) for c in (n, own))))
        gram, n, own = (np.concatenate(c) for c in zip(*parts, strict=True))
        order_ = np.argsort(gram, kind="stable")
        gram, n, own = gram[order_], n[order_], own[order_]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
        sums = [np.add.reduceat(c, starts) if len(starts) else c for c in (n, own)]
        block = np.full(len(starts), key[0].as_py(), dtype=np.int32)
        return pa.table({"gram": gram[starts], "block": block, "n": sums[0], "n_target": sums[1]})

    both = docs.groupBy("block").cogroup(ids.groupBy("block"))
    return both.applyInArrow(run, "gram bigint, block int, n bigint, n_target bigint")


_SCORE = "doc_id {kind}, n_tokens bigint, target_loss double, background_loss double"


def _dealt(docs: DataFrame, ids: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Documents and ids of the target with their block.

    Rows with a null id are dealt by their text; rows of an id that many share
    are dealt over several blocks by their text, and the id is sent to each.
    """
    parts = F.broadcast(frequent(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"))).drop("c"))
    block = lambda salt: F.pmod(F.xxhash64("doc_id", salt), F.lit(number)).cast("int")
    own: Column = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.expr("pmod(xxhash64(text), coalesce(parts, 1L))"))
    copies = ids.join(parts, "doc_id", "left").withColumn("salt", F.expr("explode(sequence(0L, coalesce(parts, 1L) - 1))"))
    return docs.join(parts, "doc_id", "left").withColumn("block", block(own)).drop("parts"), copies.select("doc_id", block(F.col("salt")).alias("block"))


def scores(
    docs: DataFrame, target: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING,
    block_bytes: int = BLOCK_BYTES, doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Mean losses of every document, and their difference.

    ``target`` holds, in a column named as ``doc``, the ids of the documents
    that the target model counts; repeats and unknown ids change nothing.
    Columns: doc_id, n_tokens (bytes), target_loss, background_loss (means, in
    nats) and score = target_loss - background_loss.  A null or empty text has
    no bytes and gets zeros.  Rows that share an id are scored each, without
    their own counts; a null id is scored and never in the target.  Further
    columns are ignored; an empty table gives no rows.  An empty target makes
    both models uniform.
    """
    kind = dict(docs.dtypes)[doc]
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = target.select(F.col(doc).cast(kind).alias("doc_id")).where("doc_id is not null").distinct()
    slim, ids = _dealt(slim, ids, max(1, -(-size // block_bytes)))
    counts = written(_count(slim, ids, order))
    # the lowest order: at most 256 rows
    bytes_ = np.zeros((2, VOCABULARY))
    for r in counts.groupBy((F.col("gram") % VOCABULARY).alias("b")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).collect():
        bytes_[:, r["b"]] = r["n"], r["t"]
    scale = bytes_[1].sum() / max(1, bytes_[0].sum())
    totals = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).withColumn("history", F.shiftright("gram", 8))
    histories = totals.groupBy("history").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"))
    known = totals.join(histories, "history").drop("history")
    answers = counts.select("gram", "block").join(known, "gram")
    sides = answers.unionByName(ids, allowMissingColumns=True)  # rows without an n-gram are ids of the target

    def run(key: tuple, texts: pa.Table, model: pa.Table) -> pa.Table:
        is_id = model.column("gram").is_null()
        target = _in_target(texts, model.filter(is_id).column("doc_id"))
        columns = {c: model.column(c).to_numpy()[~is_id.to_numpy()].astype(np.int64) for c in ("gram", "n", "t", "hn", "ht")}
        rank = np.argsort(columns["gram"])
        columns = {c: v[rank] for c, v in columns.items()}
        sizes, means = np.zeros(texts.num_rows, np.int64), np.zeros((2, texts.num_rows))
        for first, length, owner, gram, n in grams(texts.column("text"), order):
            rows = slice(first, first + len(length))
            sizes[rows] = length
            if not len(gram):
                continue
            at = np.searchsorted(columns["gram"], gram)
            byte = gram & 0xFF
            own_bytes = np.bincount(owner * VOCABULARY + byte, n, len(length) * VOCABULARY)[owner * VOCABULARY + byte]
            begins = np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] >> 8 != gram[:-1] >> 8)])
            starts = np.flatnonzero(begins)
            own_history = np.add.reduceat(n, starts)[np.cumsum(begins) - 1]
            member = target[rows][owner]
            for side, (whole, weight, mine) in enumerate((("t", 1.0, member), ("n", scale, np.ones(len(owner), bool)))):
                seen = bytes_[1 - side]
                low = (weight * (seen[byte] - own_bytes * mine) + smoothing / VOCABULARY) / (weight * (seen.sum() - length[owner] * mine) + smoothing)
                there = columns[whole][at] - n * mine
                history = columns[f"h{whole}"][at] - own_history * mine
                loss = -np.log((weight * there + smoothing * low) / (weight * history + smoothing))
                means[side, rows] = np.bincount(owner, n * loss, len(length)) / np.maximum(length, 1)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": sizes, "target_loss": means[0], "background_loss": means[1]})

    scored = slim.groupBy("block").cogroup(sides.groupBy("block"))
    out = scored.applyInArrow(run, _SCORE.format(kind=kind))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's closeness to the documents labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    found = scores(docs, good)
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))
