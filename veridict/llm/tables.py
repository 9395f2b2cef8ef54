"""Written intermediate tables, and connected components over them.

Every intermediate result that is read more than once is written as Parquet
under the folder named by ``spark.checkpoint.dir``, which all executors share,
so that a lost executor never loses it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one in local mode (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veridict-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


#: Where the paths of new tables are noted, for whoever deletes them.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def collected(paths: list[str]) -> Iterator[None]:
    """Notes in ``paths`` the tables that are written meanwhile, in this thread of control only.

    Tables that nobody notes stay for the life of the folder: results that
    other callers hold, still lazy, keep what they read.
    """
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again (lineage ends here)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete_noted(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that were noted, once the results that read them have been written.

    Plans that nothing refers to are collected, upon which Spark removes their
    shuffle files.
    """
    while paths:
        _delete(spark, paths.pop())
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


#: A key is frequent with more rows than this, and than the HOT_KEYS-th part of all: so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def frequent(counts: DataFrame, count: str = "c", total: int | None = None) -> DataFrame:
    """The frequent keys of a table with one row a key and its number of rows, and ``parts``: tasks that their rows need.

    At most HOT_KEYS rows, whatever the size of the table, so they may be
    broadcast where the rows are short.
    """
    total = (counts.agg(F.sum(count)).first()[0] or 0) if total is None else total
    limit = max(HOT_ROWS, total // HOT_KEYS)
    return counts.where(F.col(count) > limit).withColumn("parts", F.ceil(F.col(count) / limit))


def join_frequent(rows: DataFrame, groups: DataFrame, key: str | list[str], total: int | None = None) -> DataFrame:
    """Inner join with a table of one short row a key, which has the number of the key's rows in ``c``.

    Rows of frequent keys meet a broadcast table of at most HOT_KEYS rows, so
    that no task gets all rows of a key; the others are shuffled.  Both sides
    are read more than once: give written tables.
    """
    hot = frequent(groups, total=total).drop("parts")
    if hot.isEmpty():
        return rows.join(groups.hint("merge"), key).drop("c")
    hot = F.broadcast(written(hot))
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.hint("merge"), keys)
    return rows.join(hot, keys).unionByName(rest).drop("c")


def join_salted(rows: DataFrame, table: DataFrame, keys: list[str], counted: DataFrame) -> DataFrame:
    """Inner join with a table of one long row a key; rows of a frequent key are dealt over copies of its row.

    ``counted`` is a written table with as many rows of each key as ``rows``.
    """
    counts = counted.groupBy(*keys).agg(F.count("*").alias("c")).where(F.col("c") > HOT_ROWS)
    parts = F.broadcast(written(frequent(written(counts), total=counted.count()).drop("c")))
    other = [c for c in rows.columns if c not in keys]
    salt = F.coalesce(F.pmod(F.xxhash64(*(other or keys)), F.col("parts")), F.lit(0))
    copies = F.expr("explode(sequence(0L, coalesce(parts, 1L) - 1))")
    salted = rows.join(parts, keys, "left").withColumn("_salt", salt.cast("long")).drop("parts")
    copied = table.join(parts, keys, "left").withColumn("_salt", copies).drop("parts")
    return salted.join(copied, [*keys, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of an undirected graph.

    ``edges`` has columns ``a`` and ``b``.  Returns ``node`` and ``component``
    for every node that has an edge.  Alternates large-star and small-star
    steps; each step finds every node's least neighbour by an aggregation with
    map-side combining and takes it back to the edges by a join in which
    frequent nodes are not shuffled, so a hub with a third of all edges is not
    gathered anywhere; all other rows are shuffled at every size.  The number of steps grows with the logarithm of the
    longest path.
    """
    links = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    number = links.count()
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        lowest = written(least.select("a", F.least("a", "m").alias("m"), "c"))
        large = join_frequent(both.where("b > a"), lowest, "a", 2 * number).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct())
        floor = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")))
        ends = F.array(F.col("a"), F.col("b"))
        small = join_frequent(large, floor, "a", number).select(F.explode(ends).alias("a"), F.col("m").alias("b"))
        after = written(small.where("a <> b").distinct())
        # both sets hold distinct rows, so a differing count or one lost row shows a change
        before, number = number, after.count()
        if number == before and links.join(after.hint("merge"), ["a", "b"], "left_anti").isEmpty():
            roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        for done in (links, lowest, large, floor):
            forget(done)
        links = after
