"""Which runs, models and topics take part, and topics of what is valid."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions.text import model_slug, safe_suffix, strip


def listed(text: str | None) -> list[str]:
    """Names of a comma-separated list, without blanks; none for a missing one."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def allowed(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose column is one of ``names``; all rows if there are no names."""
    return rows.where(F.col(column).isin(list(names))) if names else rows


def first_runs(rows: DataFrame, number: int | None, run: str = "run_id") -> DataFrame:
    """Rows of the first runs by name; all if ``number`` is None.  The limit is the feature."""
    if number is None:
        return rows
    return rows.join(rows.select(run).distinct().orderBy(run).limit(number), run, "left_semi")


def matching_runs(rows: DataFrame, pattern: str, run: str = "run_id") -> DataFrame:
    """Rows of runs whose name matches a shell pattern; all rows if none does."""
    fits = F.coalesce(F.col(run).rlike("^" + fnmatch.translate(pattern)), F.lit(False))
    none = rows.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(none), how="cross").where(fits | ~F.col("_any")).drop("_any")  # one row of one flag


def without_examples(rows: DataFrame, name: str = "_EXAMPLE", column: str = "generator") -> DataFrame:
    """Rows of real generators; a missing name counts as one."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(name)))


def by_judges(rows: DataFrame, judges: DataFrame, column: str = "generator") -> DataFrame:
    """Rows whose generator is a judge (column ``judge``), by name or by its form in file names."""
    names = judges.select(strip(F.col("judge")).alias("_name"))
    known = names.select("_name").union(names.select(model_slug(F.col("_name")))).distinct().where("_name <> ''")
    names_of = rows.select(column).distinct().withColumn("_plain", strip(F.col(column))).where("_plain <> ''")
    keys = names_of.withColumn("_name", F.explode(F.array_distinct(F.array("_plain", model_slug(F.col("_plain"))))))
    return rows.join(keys.join(known, "_name", "left_semi").select(column).distinct(), column, "left_semi").select(*rows.columns)


def default_models(rows: DataFrame, model: str = "model", generator: str = "generator") -> DataFrame:
    """Rows of answering models that are generators, too; all rows if none is."""
    # names once each before they meet, or all rows of a name would go to one task
    both = rows.select(F.col(model).alias("_m")).distinct().intersect(rows.select(F.col(generator).alias("_m")).distinct())
    some = both.agg((F.count("*") > 0).alias("_any"))
    kept = rows.join(both.withColumn("_known", F.lit(True)), F.col(model) == F.col("_m"), "left").join(F.broadcast(some), how="cross")  # one flag
    return kept.where(F.col("_known") | ~F.col("_any")).select(*rows.columns)


def contains_text(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that hold ``text`` in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def frequent_topics(items: DataFrame, least: int = 5, topic: str = "topic", item: str = "item") -> DataFrame:
    """Rows of topics with at least ``least`` different items."""
    counts = items.groupBy(topic).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") >= least)
    return items.join(counts.select(topic), topic, "left_semi")


def with_default(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default: str = "unknown") -> DataFrame:
    """Rows with ``value`` out of a table with one row a key; ``default`` where it has none."""
    return rows.join(table.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def unknown_references(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows that refer to something that isn't there; a correct input has none."""
    return rows.join(known.select(*keys), list(keys), "left_anti")


def item_metadata(attempts: DataFrame, order: str) -> DataFrame:
    """Each item's first topic and quiz that are not missing, and how many different ones it has (n_topics, n_quizzes)."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return attempts.groupBy("item").agg(
        first("topic").alias("topic"), first("quiz").alias("quiz"), F.count_distinct("topic").alias("n_topics"), F.count_distinct("quiz").alias("n_quizzes")
    )


def specialty(target: Column, mapped: Column) -> Column:
    """Struct (topic, source): the target topic, else the mapped one; source is target, mapped or unassigned."""
    a, b = (F.when(strip(c) != "", strip(c)) for c in (target, mapped))
    source = F.when(a.isNotNull(), "target").when(b.isNotNull(), "mapped").otherwise("unassigned")
    return F.struct(F.coalesce(a, b).alias("topic"), source.alias("source"))


def valid_topics(questions: DataFrame, accepted: DataFrame, topics: DataFrame) -> DataFrame:
    """generator, topic, n of accepted questions that have a topic; ``topics`` has run_id, unit and topic."""
    kept = questions.join(accepted, ["run_id", "unit"], "left_semi").join(topics.where("topic is not null"), ["run_id", "unit"])
    return kept.groupBy("generator", "topic").agg(F.count("*").alias("n"))


def run_status(questions: DataFrame, ratings: DataFrame, topics: DataFrame) -> DataFrame:
    """Why a run counts or not: included, no_ratings, no_topics."""
    runs = questions.groupBy("generator", "run_id").agg(F.count("*").alias("n_questions"))
    rated = ratings.select("run_id").distinct().withColumn("_rated", F.lit(True))
    labelled = topics.where("topic is not null").select("run_id").distinct().withColumn("_labelled", F.lit(True))
    joined = runs.join(rated, "run_id", "left").join(labelled, "run_id", "left")
    status = F.when(F.col("_rated").isNull(), "no_ratings").when(F.col("_labelled").isNull(), "no_topics").otherwise("included")
    return joined.select("generator", "run_id", "n_questions", status.alias("status"))


def accumulated_topics(questions: DataFrame, accepted: DataFrame, topics: DataFrame) -> DataFrame:
    """scope (all, valid), generator, topic, n, total; a scope's total also counts questions without a topic."""
    marked = questions.join(topics, ["run_id", "unit"], "left").join(accepted.withColumn("_ok", F.lit(True)), ["run_id", "unit"], "left")
    scopes = F.when(F.col("_ok"), F.array(F.lit("all"), F.lit("valid"))).otherwise(F.array(F.lit("all")))
    counts = marked.withColumn("scope", F.explode(scopes)).groupBy("scope", "generator", "topic").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("scope", "generator"))  # one row a topic
    return counts.withColumn("total", total).where("topic is not null")


def batch_quizzes(quizzes: DataFrame, tag: str, stem: str = "quizbench_manifest") -> DataFrame:
    """quiz_id of the manifests of a tag (``<stem>_<tag>*.json``) and of those without one, each once."""
    name = F.col("file_name")
    own = name.startswith(f"{stem}_{tag}") & name.endswith(".json")
    return quizzes.where(own | (name == f"{stem}.json")).select("quiz_id").distinct()


def of_batch(runs: DataFrame, quizzes: DataFrame, tag: str, run: str = "run", stem: str = "quizbench_manifest") -> DataFrame:
    """The runs whose quiz a manifest of the tag lists, or one without a tag.

    ``quizzes`` has quiz_id and file_name.  No manifest, or none of whose
    quizzes has a run, is an error: an empty report would look like a result.
    """
    listed = batch_quizzes(quizzes, tag, stem)
    if listed.isEmpty():
        raise ValueError(f"no manifests for batch tag {tag!r}")
    found = runs.join(listed.withColumnRenamed("quiz_id", run), run, "left_semi")
    if found.isEmpty():
        raise ValueError(f"no runs of batch tag {tag!r}")
    return found


def next_seed(runs: DataFrame, base: int = 0, generator: str = "generator", seed: str = "seed") -> DataFrame:
    """generator, start: by how much new seeds are above ``base``, so that none is used twice."""
    return runs.groupBy(generator).agg((F.greatest(F.lit(base), F.coalesce(F.max(seed) + 1, F.lit(base))) - base).alias("start"))


def newest_file(hints: DataFrame, index: DataFrame) -> DataFrame:
    """quiz_id, path: the newest file that a manifest names, else the newest one found; both have quiz_id, path, modified."""
    newest = lambda df, name: df.groupBy("quiz_id").agg(F.max_by("path", F.struct("modified", "path")).alias(name))
    both = newest(hints, "a").join(newest(index, "b"), "quiz_id", "full_outer")
    return both.select("quiz_id", F.coalesce("a", "b").alias("path"))


def base_manifest(manifests: DataFrame, preferred: str) -> DataFrame:
    """generator, path: the manifest of the preferred name, else the newest; ties by name, then path."""
    rank = F.struct((F.col("file_name") == preferred).alias("p"), "modified", "file_name", "path")
    return manifests.groupBy("generator").agg(F.max_by("path", rank).alias("path"))


def merged_lists(manifests: DataFrame, key: str, *lists: str) -> DataFrame:
    """Sorted union of each list column over the manifests of a key."""
    every = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]  # short lists of few manifests
    return manifests.groupBy(key).agg(*every)


def topic_table(counts: DataFrame, generators: Sequence[str]) -> DataFrame:
    """A row a topic, a column a generator: shares of each generator's questions."""
    total = F.sum("n").over(Window.partitionBy("generator"))
    shares = counts.where(F.col("generator").isin(list(generators))).withColumn("share", F.round(F.col("n") / total, 6))
    wide = shares.groupBy("topic").pivot("generator", list(generators)).agg(F.first("share"))
    return wide.select("topic", *(F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias(f"share_{safe_name(g)}") for g in generators))


def safe_name(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text)


def current_topics(counts: DataFrame, targets: Sequence[str], most: int = 15) -> DataFrame:
    """Report of a distribution (topic, n): targets by number (also absent ones), the most frequent others, and a sum of the rest.

    Columns: part (target, extra, rest), topic, n, share.
    """
    total = F.sum("n").over(Window.partitionBy())
    counts = counts.groupBy("topic").agg(F.sum("n").alias("n"))
    shared = counts.withColumn("share", F.round(F.col("n") / total, 6))
    own = counts.sparkSession.createDataFrame([(t,) for t in targets], "topic string").join(shared, "topic", "left")
    own = own.select(F.lit("target").alias("part"), "topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "topic"))  # one row a topic
    others = shared.where(~F.col("topic").isin(list(targets))).withColumn("_place", place)
    extra = others.where(F.col("_place") <= most).select(F.lit("extra").alias("part"), "topic", "n", "share")
    rest = others.where(F.col("_place") > most).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.round(F.sum("share"), 6).alias("share"))
    rest = rest.where("k > 0").select(F.lit("rest").alias("part"), F.col("k").cast("string").alias("topic"), "n", "share")
    return own.unionByName(extra).unionByName(rest)


def suffix_of(*parts: str) -> Column:
    """A suffix for file names of what was chosen."""
    return safe_suffix(F.concat_ws("_", *map(F.lit, parts)))
