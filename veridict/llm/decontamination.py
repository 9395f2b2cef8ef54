"""Benchmark decontamination by spaced seeds.

Fixed masks of word positions are hashed at every word of every document and
of every benchmark item; a mask ignores the positions it leaves out, so words
replaced there do not hide a hit.  Around a hit, document and item are laid on
one another and the best-scoring aligned stretch is kept if at least four of
five of its words agree.

Both sides stay tables.  The items' seeds also fill a bitmap of bounded size,
against which one pass over the documents leaves out seeds that no item has;
the others are joined with the items' seeds, and each place where a document
and an item meet is verified in a stream sorted by document.  Documents of one
text are looked at once, and rows of frequent seeds, items and texts are dealt
over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.tables import join_salted, written
from veridict.llm.words import mix64, seeded, signed, words

#: Word positions that the masks look at.  The first two hit every stretch of 13
#: words of which any two were replaced, all four every stretch of 13 words or
#: more of which any fifth was: 15 with 3, 20 with 4 and 25 with 5 are enumerated,
#: and a longer stretch holds one of 13 to 25 with no larger share replaced.
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 5, 6, 7), (0, 1, 2, 9, 10, 11), (0, 1, 2, 4, 5, 6))
#: With the masks that fit, this one hits every item of 9 to 12 words of which any fifth was replaced.
SHORT_MASK = (0, 1, 2, 4)
#: Items of fewer words must occur unchanged.
WHOLE_BELOW = 9
#: Shortest overlap, in words; the whole item where it is shorter.
MIN_WORDS = 13
#: Items of fewer words than this hold too little to be told from chance.
LEAST_WORDS = 4
#: A mismatch costs as much as this many matches gain: an overlap agrees in 4 of 5 words.
MISMATCH = 4
#: The bitmap has about this many bits for each seed of the benchmark, within these powers of two (16 MiB at most).
#: What a full bitmap lets pass is only joined in vain.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 256, 20, 27
#: Three places of the bitmap come from these bits of a seed.
_SHIFTS = (0, 20, 37)
#: Up to this many texts (32 bytes each) are taken out by a broadcast, more by a shuffle in which a text has _PARTS parts.
BROADCAST_TEXTS, _PARTS = 1_000_000, 64

#: Every mask with the least and most words of the items it is for; the shortest items are hashed whole.
_ALL_MASKS = (
    [(m, WHOLE_BELOW, None) for m in MASKS]
    + [(SHORT_MASK, WHOLE_BELOW, MIN_WORDS - 1)]
    + [(tuple(range(c)), c, c) for c in range(LEAST_WORDS, WHOLE_BELOW)]
)


def _seeds(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, text and place of every word at which the mask of this number stays in its text."""
    mask = _ALL_MASKS[salt][0]
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:n] == owner[span - 1 :])
    total = np.full(len(at), seeded(5000 + salt), dtype=np.uint64)
    for j in mask:
        total += hashes[at + j] * seeded(j)
    return mix64(total), owner[at], at


def _item_seeds(items: DataFrame) -> DataFrame:
    """(kind, salt, seed, at0) of items (kind, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                for salt, (_, least, most) in enumerate(_ALL_MASKS):
                    seeds, owner, at = _seeds(w.hashes, w.bounds, salt)
                    size = w.counts[owner]
                    keep = (size >= least) & (size <= (most or size))
                    seeds, owner, at = seeds[keep], owner[keep], at[keep]
                    kind = batch.column("kind").take(pa.array(w.first + owner))
                    places = pa.array(at - w.bounds[owner], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [kind, pa.array(np.full(len(at), salt, np.int8)), pa.array(signed(seeds)), places],
                        names=["kind", "salt", "seed", "at0"],
                    )

    return items.mapInArrow(run, "kind binary, salt tinyint, seed bigint, at0 bigint")


def _item_words(items: DataFrame) -> DataFrame:
    """(kind, words) of items: the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                own = [w.hashes[w.bounds[i] : w.bounds[i + 1]].tobytes() for i in range(len(w))]
                kind = batch.column("kind").slice(w.first, len(w))
                yield pa.RecordBatch.from_arrays([kind, pa.array(own, pa.binary())], names=["kind", "words"])

    return items.mapInArrow(run, "kind binary, words binary")


def _bitmap(seeds: DataFrame) -> tuple[int, np.ndarray, list[int]]:
    """Bits of a place, the bitmap of all seeds, and the masks in use; made by an aggregation, of bounded size."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_SEED * seeds.count()).bit_length()))
    places = F.array(*(F.shiftrightunsigned("seed", s).bitwiseAND(F.lit((1 << bits) - 1)) + 1 for s in _SHIFTS))
    each = seeds.select("salt", F.explode(places).alias("p"))
    made = each.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part"), F.collect_set("salt").alias("salts")
    )
    out, salts = np.zeros(max(4096, (1 << bits) // 8), dtype=np.uint8), set()
    for row in made.toLocalIterator():
        part = np.frombuffer(row.part, dtype=np.uint8)
        out[(row.bucket - 1) * 4096 :][: len(part)] = part
        salts |= {*row.salts}
    return bits, out, sorted(salts)


def _marked(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents that may share a seed with an item, and those seeds.

    A row with ``words`` (hashes of all words) for each such row of ``docs``
    (doc_id, digest, text), and rows with ``seed`` and ``at`` of its digest.
    """
    bits, bitmap, salts = _bitmap(seeds)
    low = np.uint64((1 << bits) - 1)

    def possible(own: np.ndarray) -> np.ndarray:
        left = np.arange(len(own))
        for shift in _SHIFTS:
            place = ((own[left] >> np.uint64(shift)) & low).astype(np.int64)
            left = left[(bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        return left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column("doc_id"), batch.column("digest")
            for w in words(batch.column("text")):
                parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for salt in salts:
                    own, owner, at = _seeds(w.hashes, w.bounds, salt)
                    left = possible(own)
                    parts.append((own[left], owner[left], at[left]))
                seed, owner, at = (np.concatenate(p) for p in zip(*parts, strict=True))
                texts = np.unique(owner)
                whole = [w.hashes[w.bounds[i] : w.bounds[i + 1]].tobytes() for i in texts]
                rows, none = pa.array(w.first + np.concatenate([texts, owner])), np.zeros(len(texts), np.int64)
                is_text = np.arange(len(rows)) < len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows), digests.take(rows), pa.array(whole + [None] * len(at), pa.binary()),
                        pa.array(np.concatenate([none, signed(seed)]), mask=is_text),
                        pa.array(np.concatenate([none, at - w.bounds[owner]]), mask=is_text),
                    ],
                    names=["doc_id", "digest", "words", "seed", "at"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, words binary, seed bigint, at bigint")


def stretch(text: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int, int] | None:
    """First word in the text, words and agreeing words of the best-scoring overlap.

    ``start`` is the place in the text of the item's first word, which may lie
    before the text.
    """
    low, high = max(0, start), min(len(text), start + len(item))
    agree = text[low:high] == item[low - start : high - start]
    sums = np.concatenate([[0], np.cumsum(np.where(agree, 1, -MISMATCH))])
    end = int(np.argmax(sums - np.minimum.accumulate(sums)))
    first = int(np.argmin(sums[: end + 1]))
    least = min(MIN_WORDS, len(item))
    # the best stretch scores highest; the longest that still agrees in 4 of 5 words may reach further
    if end - first < least and sums[-1] >= 0:
        first, end = 0, len(agree)
    if end - first < least:
        wide = _longest(sums)
        if wide is None or wide[1] - wide[0] < least:
            return None
        first, end = wide
    return low + first, end - first, int(agree[first:end].sum())


def _longest(sums: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch whose sum is not negative."""
    best, lead, stack = (0, 0), np.maximum.accumulate(sums[::-1])[::-1], 0
    for first in range(len(sums)):
        while stack < len(sums) and lead[max(stack, first)] >= sums[first]:
            stack = max(stack, first) + 1
        if stack - 1 - first > best[1] - best[0]:
            best = (first, stack - 1)
    return best if best[1] else None


_FOUND = "digest binary, kind binary, first_word bigint, n_words bigint, n_agree bigint"


def _verified(meetings: DataFrame) -> DataFrame:
    """The best overlap of every text and item.

    Rows come sorted by digest, kind, start: first the words of a text, with a
    null kind, then those of the items beside it.  One text and one item are
    held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = item = current = best = None

        def emit(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 5
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _FOUND.split(", ")])

        for batch in batches:
            done = []
            rows = zip(*(batch.column(c) for c in ("digest", "kind", "start", "words")), strict=True)
            for digest, kind, start, data in rows:
                if not kind.is_valid:
                    text = np.frombuffer(data.as_buffer(), np.uint64)
                    continue
                key = (digest.as_py(), kind.as_py())
                if key != current:
                    if best is not None:
                        done.append((*current, *best))
                    current, best, item = key, None, np.frombuffer(data.as_buffer(), np.uint64)
                got = stretch(text, item, start.as_py())
                if got and (best is None or (-got[2], got[0]) < (-best[2], best[0])):
                    best = got
            yield emit(done)
        if best is not None:
            yield emit([(*current, *best)])

    return meetings.mapInArrow(run, _FOUND)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("string"), 256))


def _found(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of rows that may overlap an item, and the overlaps by digest and kind; both of written tables.

    ``docs`` has doc_id, digest and text, ``items`` kind and text, one row a kind.
    """
    seeds = written(_item_seeds(items))
    marked = written(_marked(docs, seeds))
    hits = marked.where("seed is not null").select("digest", "seed", "at")
    met = join_salted(hits, seeds.select("seed", "kind", "at0"), ["seed"], hits)
    met = written(met.select("digest", "kind", (F.col("at") - F.col("at0")).alias("start")).distinct())
    beside = join_salted(met, written(_item_words(items)), ["kind"], met)
    texts = marked.where("words is not null")
    each = texts.join(met.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("words").alias("words"))
    each = each.select("digest", F.lit(None).cast("binary").alias("kind"), F.lit(None).cast("bigint").alias("start"), "words")
    meetings = beside.select(*each.columns).unionByName(each)
    ordered = meetings.repartition("digest").sortWithinPartitions("digest", "kind", "start")
    return texts.select("doc_id", "digest"), written(_verified(ordered))


def _items(benchmark: DataFrame, text: str) -> DataFrame:
    """One row for each text of the benchmark: kind and text."""
    kept = benchmark.select(F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    return written(kept.select(_digest(F.col("text")).alias("kind"), "text"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Every document and benchmark item that overlap, with their best-scoring overlap.

    The score of an overlap is its agreeing words less four for each other one;
    where the best one is too short, the longest that agrees well enough counts.

    Columns: doc_id, item_id (types as given), first_word (from 0), n_words and
    n_agree.  Words are lower-cased in A-Z and split at ASCII white space.  An
    overlap is an aligned stretch of at least 13 words, or the whole item where
    it is shorter, in which at least 4 of 5 words agree.  Items of fewer than 4
    words, empty and null texts overlap nothing; items of 4 to 8 words must
    occur unchanged.  Repeated rows are reported each; ids may be null.  Empty
    tables give no rows; further columns are ignored.
    """
    slim = docs.select(F.col(doc).alias("doc_id"), _digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    rows, found = _found(slim, _items(benchmark, item_text))
    ids = benchmark.select(F.col(item).alias("item_id"), _digest(F.col(item_text)).alias("kind"))
    each = written(join_salted(rows, found, ["digest"], rows))
    return join_salted(each, ids, ["kind"], each).select("doc_id", "item_id", "first_word", "n_words", "n_agree")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns kept, that overlap no benchmark item.

    What an overlap is, and how nulls and short items count: as in
    ``overlaps``.  Rows with a null text are kept.
    """
    slim = docs.select(F.lit(0).alias("doc_id"), _digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    _, found = _found(slim, _items(benchmark, item_text))
    bad = written(found.select(F.col("digest").alias("__overlapping")).distinct())
    same = _digest(docs[text]) == bad["__overlapping"]
    if bad.count() <= BROADCAST_TEXTS:
        return docs.join(F.broadcast(bad), same, "left_anti")
    # a text in very many rows goes to several tasks, overlapping or not
    parted = docs.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))
    bad = bad.withColumn("__in", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    return parted.join(bad, same & (F.col("__part") == F.col("__in")), "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, with the passage's place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
