"""From responses of models to rows: quizzes, judge ratings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions import model_output as M
from veridict.functions.text import answer_letter, once, repaired_options, strip


def quiz_items(responses: DataFrame, n_options: int = 5) -> DataFrame:
    """A row for every usable item of every response.

    ``responses`` has quiz_id, raw, and may have target_topics (an array, in
    the order of the items asked for).  Columns: quiz_id, question_id (quiz and
    number among the usable items, from 001), question, options, answer,
    answer_index, explanation, target_topic (by the item's place in the
    response; blank is null).  Unusable items and responses give no rows.
    """
    topics = F.col("target_topics") if "target_topics" in responses.columns else F.lit(None).cast("array<string>")
    # outer: else Spark reads every response again to see whether it has entries; a response without any gives one that is no object
    items = responses.select("quiz_id", topics.alias("_topics"), F.posexplode_outer(M.quiz_entries(F.col("raw"))).alias("_at", "_item"))
    usable = items.where(M.entry_error(F.col("_item"), n_options).isNull())
    number = F.row_number().over(Window.partitionBy("quiz_id").orderBy("_at"))
    field = lambda name, kind="string": F.try_variant_get("_item", f"$.{name}", kind)
    letter, topic = F.upper(strip(field("answer"))), strip(F.get("_topics", F.col("_at")))
    return usable.select(
        "quiz_id", F.format_string("%s-%03d", "quiz_id", number).alias("question_id"), field("question").alias("question"),
        field("options", "array<string>").alias("options"), letter.alias("answer"), (F.ascii(letter) - 65).alias("answer_index"),
        field("explanation").alias("explanation"), F.when(topic != "", topic).alias("target_topic"),
    )


def quiz_status(requests: DataFrame, responses: DataFrame, n_options: int = 5) -> DataFrame:
    """What became of every requested quiz: status "ok" or "error", n_items and the error.

    ``requests`` has quiz_id, ``responses`` quiz_id and raw, one at most for a quiz.
    """
    usable = lambda entries: F.size(F.filter(entries, lambda i: M.entry_error(i, n_options).isNull()))
    found = responses.select("quiz_id", once(
        M.quiz_entries(F.col("raw")), lambda e: F.struct(F.lit(True).alias("there"), e.isNull().alias("broken"), F.coalesce(usable(e), F.lit(0)).alias("n"))
    ).alias("_e"))
    joined = requests.select("quiz_id").join(found, "quiz_id", "left").select("quiz_id", *(F.col(f"_e.{c}").alias(f"_{c}") for c in ("there", "broken", "n")))
    error = (
        F.when(F.col("_there").isNull(), F.lit("no result returned"))
        .when(F.col("_broken"), F.concat(F.lit("Could not parse JSON for quiz "), F.col("quiz_id")))
        .when(F.col("_n") < 1, F.concat(F.lit("Generator returned zero valid items for "), F.col("quiz_id")))
    )
    return joined.select(
        "quiz_id", F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.coalesce("_n", F.lit(0)).alias("n_items"), error.alias("error")
    )


def ratings_of(responses: DataFrame, response: str = "raw") -> DataFrame:
    """Rows of judges with output_valid, parse_error, verdict, fail_reason, score and logical_false_reason instead of the response."""
    found = responses.withColumn("_j", M.judgement(F.col(response)))
    return found.select(
        *(c for c in responses.columns if c != response), F.col("_j.error").isNull().alias("output_valid"), F.col("_j.error").alias("parse_error"),
        F.col("_j.verdict").alias("verdict"), F.col("_j.fail_reason").alias("fail_reason"), F.col("_j.score").alias("score"),
        F.col("_j.reason").alias("logical_false_reason"),
    )


def batch_answers(items: DataFrame, lines: DataFrame, letter=answer_letter) -> DataFrame:
    """Items beside what a batch returned for them: pred, correct and model_output.

    ``items`` has custom_id and answer, ``lines`` custom_id and line (JSON with
    an error, or a response with a body), one for an id.  Items without a line
    and with an error have no prediction and are wrong.  ``letter`` reads the
    choice out of a text.
    """
    joined = items.join(lines.select("custom_id", "line"), "custom_id", "left")
    kind = lambda value: F.coalesce(F.schema_of_variant(F.try_variant_get(value, "$.error", "variant")), F.lit("VOID"))
    get = lambda value, path, default: F.coalesce(F.try_variant_get(value, path, "string"), F.lit(default))
    problem = lambda value: F.concat(F.lit("Batch error ("), get(value, "$.error.code", "unknown_code"), F.lit("): "), get(value, "$.error.message", "no error message provided"))
    failure = once(F.try_parse_json("line"), lambda value: F.when(~kind(value).isin("VOID", "OBJECT<>"), problem(value)))
    text = F.replace(M.body_text(F.get_json_object("line", "$.response.body")), F.lit("**"), F.lit(""))
    read = once(failure, lambda f: F.struct(f.isNull().alias("fine"), F.when(f.isNotNull(), f).otherwise(text).alias("output")))
    found = joined.withColumn("_r", F.when(F.col("line").isNotNull(), read)).withColumn("_pred", F.when(F.col("_r.fine"), letter(F.col("_r.output"))))
    output = F.when(F.col("line").isNull(), "Error: no result returned for this request.").otherwise(F.col("_r.output"))
    return found.select(*items.columns, F.col("_pred").alias("pred"), F.coalesce(F.col("_pred") == F.col("answer"), F.lit(False)).alias("correct"), output.alias("model_output"))


def unanswered(items: DataFrame, answered: DataFrame, by: tuple[str, ...] = ("question_id", "question")) -> DataFrame:
    """Items that no existing answer covers, so that work is not done twice."""
    return items.join(answered.select(*by).distinct(), list(by), "left_anti")


def category_accuracy(answers: DataFrame, *keys: str, category: str = "category") -> DataFrame:
    """Right and wrong answers by category and in total ("total"), for each of ``keys`` (a model, a repeated run).

    ``answers`` has pred and answer; a missing prediction is wrong.
    """
    right = F.when(F.col("pred") == F.col("answer"), 1).otherwise(0)
    counted = answers.groupBy(*keys, category).agg(F.sum(right).alias("corr"), F.count("*").alias("_n"))
    sets = [[*keys, category], [*keys]]
    both = counted.groupingSets([[F.col(c) for c in s] for s in sets], *keys, category).agg(
        F.sum("corr").alias("corr"), F.sum("_n").alias("_n"), F.grouping(category).alias("_all")
    )
    name = F.when(F.col("_all") == 1, "total").otherwise(F.col(category))
    return both.select(
        *keys, name.alias(category), "corr", (F.col("_n") - F.col("corr")).alias("wrong"), (F.col("corr") / F.col("_n")).alias("acc")
    )


def repair_options(rows: DataFrame, options: str = "options") -> DataFrame:
    """Multiple-choice rows whose options come as JSON text, with the options as an array."""
    return rows.withColumn(options, repaired_options(F.col(options)))


def question_sets(rows: DataFrame, category: str = "category") -> DataFrame:
    """Multiple-choice questions with repaired options, and the number of questions of their category (n_category).

    Questions whose options can't be read, or of which none are left, are left out.
    """
    usable = repair_options(rows).where(F.col("options").isNotNull() & (F.size("options") > 0))
    sizes = usable.groupBy(category).agg(F.count("*").alias("n_category"))
    return usable.join(sizes, category)


def head(sets: DataFrame, n: int, category: str = "category", order: str = "question_id") -> DataFrame:
    """The first ``n`` questions of every category (examples for a prompt); cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return sets.withColumn("place", place).where(F.col("place") <= n)
