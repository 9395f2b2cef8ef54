"""Topic labels: mapping onto a list of categories, and their distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions.text import blood_or_cancer, is_blood_or_cancer, is_combined_label, normalize_label, strip


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small literal table, null where the key is not in it."""
    if not table:
        return F.lit(None).cast("string")
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def check_categories(categories: Sequence[str]) -> dict[str, str]:
    """Normalised name -> category; categories that agree in it are an error."""
    out: dict[str, str] = {}
    for c in categories:
        name = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in c.lower().replace("&", " and ")).split())
        if out.setdefault(name, c) != c:
            raise ValueError(f"categories {out[name]!r} and {c!r} can't be told apart")
    return out


def map_topics(
    rows: DataFrame, topic: str, categories: Sequence[str], overrides: Mapping[str, str] | None = None,
    drop: Sequence[str] = (), misc: str | None = None, combined_to_misc: bool = False, unmapped: str = "keep",
) -> DataFrame:
    """Append ``mapped`` and ``reason``.

    In this order: null or empty labels give null; labels in ``drop`` are
    dropped; a category by its name; by its normalised name; an override;
    combined labels as ``misc`` if asked for; else by ``unmapped``: keep (the
    label itself), misc, drop, or error (fails the query).
    """
    index = check_categories(categories)
    normal = lambda names: {k: v for v in names for k in [next(iter(check_categories([v])))]}
    over = {next(iter(check_categories([k]))): v for k, v in (overrides or {}).items()}
    raw, label = F.col(topic), normalize_label(F.col(topic))
    empty = raw.isNull() | (strip(raw) == "")
    dropped = F.coalesce(label.isin(list(normal(drop))), F.lit(False)) if drop else F.lit(False)
    exact = raw.isin(list(categories))
    by_name, by_override = _lookup(label, index), _lookup(label, over)
    combined = F.coalesce(is_combined_label(raw), F.lit(False)) if combined_to_misc and misc else F.lit(False)
    last = {"keep": raw, "misc": F.lit(misc), "drop": F.lit(None).cast("string")}
    if unmapped == "error":
        rest = F.raise_error(F.concat(F.lit("no category for topic "), raw)).cast("string")
    else:
        rest = last[unmapped]
    steps = [
        (raw.isNull(), F.lit(None).cast("string"), "none"), (empty, F.lit(None).cast("string"), "empty"),
        (dropped, F.lit(None).cast("string"), "dropped"), (exact, raw, "canonical_exact"),
        (by_name.isNotNull(), by_name, "canonical_normalized"), (by_override.isNotNull(), by_override, "override"),
        (combined, F.lit(misc), "combined_to_misc"),
    ]
    mapped = reason = None
    for test, value, why in steps:
        mapped = F.when(test, value) if mapped is None else mapped.when(test, value)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return rows.withColumns({"mapped": mapped.otherwise(rest), "reason": reason.otherwise(f"unmapped_{unmapped}")})


def canonical(raw: Column, categories: Sequence[str], overrides: Mapping[str, str] | None = None, normalize: bool = True) -> Column:
    """Struct (topic, error): the category that a label names, else the one that its override names.

    An override that is no category itself is an error, as is a label without
    one.  With ``normalize`` labels and keys of overrides are compared by their
    normalised names; an override's target always is.
    """
    index = check_categories(categories)
    over = {(next(iter(check_categories([k]))) if normalize else k.strip()): next(iter(check_categories([v]))) for k, v in (overrides or {}).items()}
    name = normalize_label(raw) if normalize else strip(raw)
    first, other = _lookup(name, index), _lookup(name, over)
    topic = F.coalesce(first, _lookup(other, index))
    wrong = F.concat(F.lit("no category: "), F.coalesce(F.when(first.isNull(), other), raw, F.lit("")))
    return F.struct(topic.alias("topic"), F.when(topic.isNull(), wrong).alias("error"))


def outside(rows: DataFrame, mapped: str, categories: Sequence[str], misc: str | None = None) -> DataFrame:
    """Mapped labels that are no category."""
    return rows.where(F.col(mapped).isNotNull() & ~F.col(mapped).isin([*categories, *([misc] if misc else [])])).select(mapped).distinct()


def mapping_report(mapped: DataFrame, topic: str, *keys: str, examples: int = 5) -> DataFrame:
    """Per label: rows, what it became, its reason ("multiple" if several) and the ``examples`` least ids."""
    per = mapped.groupBy(*keys, topic).agg(
        F.count("*").alias("n"), F.max("mapped").alias("mapped"),
        F.when(F.count_distinct("reason") > 1, "multiple").otherwise(F.max("reason")).alias("reason"),
    )
    place = F.row_number().over(Window.partitionBy(*keys, topic).orderBy("question_id"))  # Spark cuts such a window before it shuffles
    least = mapped.select(*keys, topic, "question_id", place.alias("_place")).where(F.col("_place") <= examples)
    least = least.groupBy(*keys, topic).agg(F.sort_array(F.collect_list("question_id")).alias("examples"))
    least = least.withColumnsRenamed({c: f"_{c}" for c in (*keys, topic)})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, topic)]
    both = per.join(least, same[0] if len(same) == 1 else same[0] & same[1] if len(same) == 2 else same)
    return both.select(*keys, topic, "n", "mapped", "reason", "examples")


def response_topic(rows: DataFrame, response: str, allowed: Sequence[str]) -> DataFrame:
    """Append ``topic``: the allowed topic that a free-text response names.

    Candidates are the first line and its parts between ``;``, ``,``, ``:``,
    ``|`` and ``/``; an exact match goes before one by normalised name, that
    before a topic contained in the candidate; then the earlier candidate and
    the earlier topic win.
    """
    line = F.get(F.split(strip(F.col(response)), r"\r?\n"), F.lit(0))
    parts = F.transform(F.concat(F.array(line), F.split(line, r"[;,:|/]")), strip)
    index = check_categories(allowed)
    topics = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(n).alias("n"), F.lit(k).alias("k")) for k, (n, t) in enumerate(index.items())))

    def ranked(candidate: Column, place: Column) -> Column:
        name = normalize_label(candidate)
        return F.transform(
            topics,
            lambda t: F.struct(
                F.when(candidate == t["t"], 0).when(name == t["n"], 1).when(F.contains(name, t["n"]), 2).otherwise(9).alias("r"),
                place.alias("p"), t["k"].alias("k"), t["t"].alias("t"),
            ),
        )

    best = F.array_min(F.flatten(F.transform(parts, ranked)))
    return rows.withColumn("topic", F.when(best["r"] < 9, best["t"]))


def distribution(rows: DataFrame, generator: str, topic: str) -> DataFrame:
    """generator, topic, n, total, share on the full grid of generators and topics; nulls are "unknown".

    Both sides of the grid are few: the topics travel as one array.
    """
    t = F.coalesce(F.col(topic), F.lit("unknown"))
    counts = rows.groupBy(F.col(generator).alias("generator"), t.alias("topic")).agg(F.count("*").alias("n"))
    grid = counts.agg(F.collect_set("generator").alias("g"), F.collect_set("topic").alias("t"))
    grid = grid.select(F.explode("g").alias("generator"), "t").select("generator", F.explode("t").alias("topic"))
    full = grid.join(counts, ["generator", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("generator"))
    return full.withColumn("total", total).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def summary(rows: DataFrame, topic: str, order: str, *keys: str) -> DataFrame:
    """Questions, unclassified ones and the most frequent topic (the first seen among equals)."""
    counts = rows.groupBy(*keys, topic).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.struct(F.col("n"), -F.col("first"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("num_questions"), F.sum(F.when(F.col(topic).isNull(), F.col("n")).otherwise(0)).alias("num_unclassified"),
        F.max_by(F.when(F.col(topic).isNotNull(), F.col(topic)), F.when(F.col(topic).isNotNull(), rank)).alias("majority_topic"),
    )


def first_seen(rows: DataFrame, topic: str, order: str) -> DataFrame:
    """Topics numbered by first appearance, "unknown" last."""
    firsts = rows.groupBy(topic).agg(F.min(order).alias("first"))
    key = F.struct((F.col(topic) == "unknown").alias("u"), "first", topic)
    listed = firsts.agg(F.sort_array(F.collect_list(key)).alias("o"))  # one entry a topic
    return listed.select(F.posexplode("o").alias("topic_ord", "e")).select(F.col(f"e.{topic}").alias(topic), "topic_ord")


def remainders(targets: DataFrame, current: DataFrame) -> DataFrame:
    """category, target, current, remaining, overshoot, and extra for categories without a target.

    ``targets`` has category and target, ``current`` category and n.
    """
    both = targets.join(current, "category", "full_outer")
    t, n = F.coalesce("target", F.lit(0)), F.coalesce("n", F.lit(0))
    known = F.col("target").isNotNull()
    return both.select(
        "category", t.alias("target"), n.alias("current"), F.greatest(t - n, F.lit(0)).alias("remaining"),
        F.when(known, F.greatest(n - t, F.lit(0))).otherwise(0).alias("overshoot"), F.when(known, 0).otherwise(n).alias("extra"),
    )


def refined(mapped: DataFrame, responses: DataFrame, key: str = "question_id") -> DataFrame:
    """Mapped topics in which labels that name hematology and oncology together are told apart by a model's response.

    ``mapped`` has the key, topic and mapped, ``responses`` the key and
    response.  The label before is kept in ``mapped_before``, where it changed.
    """
    joined = mapped.join(responses.select(key, "response"), key, "left")
    chosen = F.when(is_blood_or_cancer(F.col("topic")), blood_or_cancer(F.col("response")))
    changed = chosen.isNotNull() & ~F.coalesce(chosen == F.col("mapped"), F.lit(False))
    return joined.select(
        *(c for c in mapped.columns if c != "mapped"), F.coalesce(chosen, "mapped").alias("mapped"), F.when(changed, F.col("mapped")).alias("mapped_before")
    )
