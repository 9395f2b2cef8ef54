"""Exact Jaccard join of documents by word n-grams.

The document by n-gram incidence matrix is multiplied with its transpose in
blocks, and only where an entry can matter.  N-gram space is cut by hash into
as many column blocks as documents of a size class may differ in n-grams, plus
a few: two documents that reach the similarity then have an identical,
sub-row in some column block, since their difference is too small to touch
every one.  Sub-rows that most documents have, made of passages that many
share, go unused as far as the number of column blocks allows.  Documents
connected by equal sub-rows are a family; only within families can documents
link.

A family's rows are cut into row blocks of bounded size, and every two row
blocks are one task: it accumulates the overlap of all their pairs (columns
with many documents as a dense product, the others by their postings),
discards pairs below the bound that the two sizes give, and returns the
connected groups of what is left as stars.  So no task holds more than two row
blocks, however large a family is, and pairs are never rows.

Documents with equal n-gram sets are one class, represented by the smallest
id, and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.llm.tables import connected_components, join_frequent, written
from veridict.llm.words import mix64, seeded, shingles, signed

#: Bounds of a row block: documents, and n-grams of all of them (a longer document is a block of its own).
BLOCK_ROWS, BLOCK_GRAMS = 1000, 250_000
#: Shares of the possible differences that are added in sub-rows which may go unused, and the least number of them:
#: the shortest sub-rows of a document, and those that most other documents have.
SHORT_PERCENT, OFTEN_PERCENT, SHORT_LEAST, OFTEN_LEAST = 10, 18, 1, 2
#: Columns with more documents than this are multiplied as a dense matrix.
DENSE = 24


def _floor_sum(total: int, percent: int) -> int:
    """Most n-grams in which two sets of ``total`` in all may differ at a similarity of ``percent``."""
    return total * (100 - percent) // (100 + percent)


def size_classes(limit: int, percent: int) -> np.ndarray:
    """Lower bounds of size classes: similar documents are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] <= limit:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, dtype=np.int64)


def _blocks_of(upper: int, percent: int) -> tuple[int, int, int]:
    """Column blocks for documents of at most ``upper`` n-grams, and how many short and frequent sub-rows may go unused.

    No blocks where only equal sets reach the similarity.
    """
    differ = _floor_sum(2 * upper, percent)
    if not differ:
        return 0, 0, 0
    short = max(SHORT_LEAST, differ * SHORT_PERCENT // 100)
    often = max(OFTEN_LEAST, differ * OFTEN_PERCENT // 100)
    return differ + 1 + short + often, short, often


def signatures(values: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """Keys of the sub-rows of one document; ``values`` are its distinct n-gram hashes, sorted.

    Two similar documents agree in more sub-rows than may go unused, so each
    may leave out some, by an order that both have in common: first its
    shortest ones (here), then those that most documents have (``_links``).
    Documents that merely share a passage would have just these in common.
    The first of any sub-rows they agree in, by either order reversed, is left
    out by neither.  The lowest bit of a key tells the parity of the size class.
    """
    size = len(values)
    own = int(np.searchsorted(classes, size, "right")) - 1
    mixed, keys = mix64(values ^ seeded(77)), [np.zeros(0, np.uint64)]
    for scheme in (own, own + 1):
        blocks, short, _ = _blocks_of(int(classes[scheme + 1]) - 1, percent)
        if not blocks:
            continue
        at = ((values >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        filled = np.bincount(at.astype(np.int64), minlength=blocks)
        total = np.zeros(blocks, dtype=np.uint64)  # values are sorted, so a block's values are a run
        total[filled > 0] = np.add.reduceat(mixed, (np.cumsum(filled) - filled)[filled > 0])
        shortest = int(np.partition(filled, short)[short])  # no more than `short` sub-rows are shorter
        which = np.flatnonzero(filled >= shortest)
        salt = (which.astype(np.uint64) << np.uint64(20)) + np.uint64(scheme + 1)
        key = mix64(total[which] + filled[which].astype(np.uint64) * seeded(78) + salt * seeded(79))
        keys.append(key & ~np.uint64(1) | np.uint64(scheme & 1))
    return np.concatenate(keys)


def _distinct(part, i: int) -> np.ndarray:
    return np.unique(part.hashes[part.bounds[i] : part.bounds[i + 1]])


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, and a 128-bit digest of the n-gram set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, one, two = np.zeros(batch.num_rows, np.int64), [], []
            for part in shingles(batch.column("text"), size, short=True):
                for i in range(len(part)):
                    own = _distinct(part, i)
                    counts[part.first + i] = len(own)
                    one.append((mix64(own ^ seeded(1)).sum(dtype=np.uint64) ^ np.uint64(len(own))).astype(np.int64))
                    two.append(mix64(own ^ seeded(2)).sum(dtype=np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(np.array(one, np.int64)), pa.array(np.array(two, np.int64))],
                names=["doc_id", "n_shingles", "d1", "d2"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint")


def _sub_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, doc_id) for every sub-row of every document with n-grams.

    Of documents with equal n-grams a task looks only at those that may have the smallest id.
    """
    classes = size_classes(1 << 40, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part in shingles(batch.column("text"), size, short=True):
                keys = []
                for i in range(len(part)):
                    own = _distinct(part, i)
                    digest = int(mix64(own ^ seeded(3)).sum(dtype=np.uint64)) ^ len(own)
                    if len(own) and least.get(digest, ids[part.first + i] + 1) > ids[part.first + i]:
                        least[digest] = ids[part.first + i]
                        keys.append(signatures(own, percent, classes))
                    else:
                        keys.append(own[:0])
                owner = np.repeat(ids[part.first : part.first + len(part)], [len(k) for k in keys])
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(flat)), pa.array(owner)], names=["key", "doc_id"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles(batch.column("text"), size, short=True):
                own = [_distinct(part, i) for i in range(len(part))]
                ids = batch.column("doc_id").slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in own], pa.binary())], names=["doc_id", "grams"])

    return docs.mapInArrow(run, "doc_id bigint, grams binary")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another row has, too; they come sorted by key in each partition.

    Only one row is held, so a key may have any number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # the last row, and whether it is shared
        cut = lambda key, doc: pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc)], names=["key", "doc_id"])
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "doc_id"), strict=False))
            same = key[1:] == key[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[bool(held[2].any())], same])
            held = [key[-1:], doc[-1:], shared[-1:]]
            yield cut(key[:-1][shared[:-1]], doc[:-1][shared[:-1]])
        yield cut(held[0][held[2]], held[1][held[2]])

    return rows.mapInArrow(run, "key bigint, doc_id bigint")


def _stars(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents beside the first one of a key, for all keys that don't go unused."""
    classes = [int(c) for c in size_classes(1 << 40, percent)]
    often = [_blocks_of(upper - 1, percent)[2] for upper in classes[1:]]
    own = F.size(F.filter(F.array(*(F.lit(c) for c in classes)), lambda c: c <= F.col("n_shingles"))) - 1
    unused = lambda scheme: F.element_at(F.array(*map(F.lit, often)), scheme + 1)
    limits = reps.withColumn("own", own).select("doc_id", (F.col("own") % 2).alias("parity"), unused(F.col("own")).alias("even"), unused(F.col("own") + 1).alias("odd"))
    known = written(rows.join(limits.hint("merge"), "doc_id").withColumn("second", F.expr("(key & 1) <> parity")))
    counts = written(known.groupBy("key").agg(F.count("*").alias("c"), F.count("*").alias("f")).where("c > 1"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "second").orderBy(F.desc("f"), "key"))  # at most a document's sub-rows
    ranked = join_frequent(known, counts, "key").withColumn("rank", rank)
    kept = written(ranked.where(F.col("rank") > F.when(F.col("second"), F.col("odd")).otherwise(F.col("even"))).select("key", "doc_id"))
    heads = written(kept.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1"))
    return join_frequent(kept, heads, "key").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common n-grams of every row of ``left`` with every row of ``right`` (indices into ``sets``)."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    number = np.diff(np.concatenate([starts, [len(flat)]]))
    heavy = np.flatnonzero(number > DENSE)
    column = np.repeat(np.arange(len(heavy)), number[heavy])
    dense = np.zeros((n, len(heavy)), dtype=np.float32)
    dense[row[np.isin(np.repeat(np.arange(len(starts)), number), heavy)], column] = 1
    total = (dense[left] @ dense[right].T).astype(np.int64)
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for size in np.unique(number[(number > 1) & (number <= DENSE)]):
        columns = starts[number == size]
        for at in range(0, len(columns), 2_000_000 // (size * size)):
            members = row[columns[at : at + 2_000_000 // (size * size), None] + np.arange(size)]
            x, y = place[0, members][:, :, None], place[1, members][:, None, :]
            both = (x >= 0) & (y >= 0) & (members[:, :, None] != members[:, None, :])
            total += np.bincount((x * len(right) + y)[both], minlength=total.size).reshape(total.shape)
    return total


def linked_groups(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Stars that connect the rows which links between the two sides connect.

    ``side`` is 0 or 1 for each row, or 0 for all if the rows are to be
    compared with one another.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    if not len(left) or not len(right):
        return []
    common = overlaps(sets, left, right)
    union = size[left][:, None] + size[right][None, :] - common
    link = 100 * common >= percent * union
    link[left[:, None] == right[None, :]] = False
    out, fresh = [], np.ones(len(sets), dtype=bool)
    for root in range(len(sets)):
        if not fresh[root]:
            continue
        fresh[root], front = False, np.array([root])
        while len(front):
            near = np.concatenate(
                [right[link[np.isin(left, front)].any(axis=0)], left[link[:, np.isin(right, front)].any(axis=1)]]
            )
            front = np.unique(near)
            front = front[fresh[front]]
            fresh[front] = False
            out += [(root, int(x)) for x in front]
    return out


def _product(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of every task; rows (task, side, doc_id, grams) come sorted by task in each partition."""

    def solve(ids: np.ndarray, side: np.ndarray, grams: list[bytes]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(g, dtype=np.uint64) for g in grams]
        return [(int(ids[a]), int(ids[b])) for a, b in linked_groups(sets, side, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), [])
        out: list[tuple[int, int]] = []

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "doc_id", "side")]
            task, ids, side = (np.concatenate([h, o]) for h, o in zip(held, own, strict=False))
            grams = held[3] + batch.column("grams").to_pylist()
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            at = 0
            for to in cuts:
                out += solve(ids[at:to], side[at:to], grams[at:to])
                at = to
            held = (task[at:], ids[at:], side[at:], grams[at:])  # one task's rows at most
            yield emit()
        if len(held[0]):
            out += solve(held[1], held[2], held[3])
        yield emit()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _links(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame | None:
    """doc_id and component of every document of ``reps`` that links with another; reps has doc_id and n_shingles."""
    rows = _sub_rows(docs, size, percent).repartition("key").sortWithinPartitions("key")
    stars = written(_stars(_shared(rows), reps, percent))
    if stars.isEmpty():
        return None
    family = connected_components(stars).withColumnRenamed("node", "doc_id")
    # joins are shuffled at every size: nothing bounds the number of ids, and a table that is small as Parquet may be
    # broadcast by its size on disk and be many times that on the driver
    family = written(family.join(reps.hint("merge"), "doc_id"))
    sizes = family.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    members = family.join(sizes.where("rows > 1").select("component", parts.alias("parts")).hint("merge"), "component")
    block = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    # a row block meets every row block of its family: as many copies of a row as the family has blocks
    tasks = members.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select(
        "doc_id", F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("task"),
        (F.col("i") > F.col("j")).cast("tinyint").alias("side"),
    )
    wanted = members.select("doc_id").hint("merge")
    sets = _sets(docs.join(wanted, "doc_id", "left_semi"), size)
    joined = tasks.join(sets.hint("merge"), "doc_id").repartition("task").sortWithinPartitions("task")
    links = _product(joined, percent)
    return connected_components(links).withColumnRenamed("node", "doc_id")


def components(docs: DataFrame, size: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are lower-cased in A-Z and split at ASCII white space; a document's
    set holds its distinct runs of ``size`` words, or its whole sequence of
    words where that is shorter.  Documents link when 100 * intersection >=
    percent * union, compared in whole numbers.  component_id is the smallest
    doc_id that links reach.  Null, empty and word-less texts have no n-grams
    and link with nothing.  Rows with the same non-null id and different texts
    are documents of their own in the comparison but share that id; ids must
    be whole numbers, rows with a null id are left out.  Further columns are
    ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    profiles = written(_profiles(slim, size))
    classes = profiles.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = written(classes)
    linked = _links(slim, classes.select(F.col("rep").alias("doc_id"), "n_shingles"), size, percent)
    if linked is not None:
        named = classes.join(linked.withColumnRenamed("doc_id", "rep").hint("merge"), "rep", "left")
        classes = named.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("rep"))
    joined = profiles.alias("p").join(classes.alias("c").hint("merge"), ["d1", "d2", "n_shingles"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, all columns kept.

    The document with the component's smallest id stays.  Rows without an id
    stay; see ``components`` for everything else.
    """
    parts = components(docs, size, percent, doc, text).where("doc_id <> component_id").select(F.col("doc_id").alias(doc))
    return docs.join(parts.distinct().hint("merge"), doc, "left_anti").select(*docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a Jaccard similarity of 0.85."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)
