"""What models return: texts in bodies of several shapes, judge verdicts and quizzes as JSON, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridict.functions.text import json_block, once, plain_punctuation, strip


def _kind(value: Column, path: str = "$") -> Column:
    """Type of what stands at a path: STRING, BOOLEAN, BIGINT, OBJECT<...>, ARRAY<...>, VOID; empty if nothing does."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit(""))


def _texts(parts: Column, kinds: tuple[str, ...]) -> Column:
    """Texts of those parts of a message whose type is one of ``kinds``."""
    fits = lambda p: F.try_variant_get(p, "$.type", "string").isin(*kinds) & (_kind(p, "$.text") == "STRING")
    found = F.transform(F.filter(parts, fits), lambda p: F.try_variant_get(p, "$.text", "string"))
    return F.coalesce(found, F.array().cast("array<string>"))


def body_text(body: Column) -> Column:
    """The text in a response body, given as JSON.

    Looks for ``output_text``, then for messages and texts in ``output``, then
    for the first of ``choices``; a JSON string is the text itself, and of any
    other body the first 2,000 characters are.
    """
    return once(body, lambda body: once(F.try_parse_json(body), lambda value: _text_of(value, F.substring(body, 1, 2000))))


def _text_of(value: Column, otherwise: Column) -> Column:
    """The text in a parsed body; ``otherwise`` where it has none."""
    kind = lambda item: F.try_variant_get(item, "$.type", "string")
    content = lambda item: F.try_variant_get(item, "$.content", "array<variant>")
    items = F.try_variant_get(value, "$.output", "array<variant>")
    chunks = F.flatten(F.transform(items, lambda i: F.when(kind(i) == "message", _texts(content(i), ("output_text", "text", "input_text"))).otherwise(_texts(F.array(i), ("output_text", "text")))))
    parts = lambda said: F.array_join(_texts(F.try_variant_get(said, "$", "array<variant>"), ("text",)), "")
    choice = once(
        F.try_variant_get(value, "$.choices[0].message.content", "variant"),
        lambda said: F.when(_kind(said).startswith("ARRAY"), parts(said)).otherwise(F.coalesce(F.try_variant_get(said, "$", "string"), F.lit(""))),
    )
    # each step is computed only if those before it have found nothing
    chosen = F.when(_kind(value, "$.choices[0]") != "", choice).otherwise(otherwise)
    joined = once(chunks, lambda c: F.when(F.size(c) > 0, F.array_join(c, "")).otherwise(chosen))
    whole = once(
        F.when(_kind(value, "$.output_text") == "STRING", F.try_variant_get(value, "$.output_text", "string")),
        lambda w: F.when(strip(w) != "", w).otherwise(joined),
    )
    return F.when(value.isNull(), otherwise).when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(whole)


def boolean_of(value: Column) -> Column:
    """Struct (value, error): true or false, also as text; anything else is an error.  ``value`` is JSON."""
    parsed = F.try_parse_json(value)
    word = F.lower(strip(F.try_variant_get(parsed, "$", "string")))
    found = F.when(_kind(parsed) == "BOOLEAN", F.try_variant_get(parsed, "$", "boolean")).when((_kind(parsed) == "STRING") & word.isin("true", "false"), word == "true")
    return F.struct(found.alias("value"), F.when(found.isNull(), "safety_flag must be a boolean").alias("error"))


#: Reasons for which a question may be invalid, and the one that says it isn't.
REASONS, NO_REASON = ("C", "N", "M", "U", "K"), "T"
_FIELDS = ("analysis", "medical_accuracy_score", "logical_validity", "logical_false_reason")


def judgement(response: Column) -> Column:
    """Struct of a judge's response: error, analysis, score, valid, reason, verdict, fail_reason.

    ``error`` says why the response can't be used and is null if it can; the
    other fields are null if it is not.  A response whose object lacks a field
    is an error, too.
    """
    return once(F.try_parse_json(json_block(response)), _judged)


def _judged(value: Column) -> Column:
    get = lambda field, kind: F.try_variant_get(value, f"$.{field}", kind)
    read = F.struct(
        value.isNull().alias("broken"), _kind(value).startswith("OBJECT").alias("object"), *(_kind(value, f"$.{f}").alias(f"{f}_kind") for f in _FIELDS),
        get("analysis", "string").alias("analysis"), get("logical_validity", "boolean").alias("valid"),
        F.upper(strip(F.coalesce(get("logical_false_reason", "string"), F.lit("none")))).alias("reason"), _score_of(value).alias("score"),
    )
    return once(read, lambda r: once(_error_of(r), lambda error: _verdict_of(r, error)))


def _score_of(value: Column) -> Column:
    get = lambda kind: F.try_variant_get(value, "$.medical_accuracy_score", kind)
    whole = once(strip(get("string")), lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")))
    return once(
        _kind(value, "$.medical_accuracy_score"),
        lambda kind: F.when(kind == "BOOLEAN", get("boolean").cast("int"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), get("double").cast("int")).when(kind == "STRING", whole),
    )


def _error_of(r: Column) -> Column:
    missing = [r[f"{f}_kind"] == "" for f in _FIELDS]
    return (
        F.when(r["broken"], "json decode error").when(~r["object"], "Parsed JSON is not an object")
        .when(missing[0] | missing[1] | missing[2] | missing[3], "a required field is missing")
        .when(r["analysis_kind"] != "STRING", "analysis must be a string")
        .when(r["logical_validity_kind"] != "BOOLEAN", "logical_validity must be a boolean")
        .when(~r["reason"].isin(*REASONS, NO_REASON), "logical_false_reason must be one of C/N/M/U/K/T")
        .when(r["score"].isNull(), "medical_accuracy_score must be an integer between 1 and 5")
        .when(~r["score"].between(1, 5), "medical_accuracy_score must be between 1 and 5")
        .when(r["valid"] & (r["reason"] != NO_REASON), "logical_false_reason must be T when logical_validity is true")
        .when(~r["valid"] & (r["reason"] == NO_REASON), "logical_false_reason must be C/N/M/U/K when logical_validity is false")
    )


def _verdict_of(r: Column, error: Column) -> Column:
    fine = lambda x: F.when(error.isNull(), x)
    return F.struct(
        error.alias("error"), *(fine(r[c]).alias(c) for c in ("analysis", "score", "valid", "reason")),
        fine(F.when(r["valid"], "PASS").otherwise("FAIL")).alias("verdict"), fine(F.when(r["valid"], "NA").otherwise(r["reason"])).alias("fail_reason"),
    )


def quiz_entries(response: Column) -> Column:
    """Items of a quiz in a model's response, as an array of JSON values; null if the response holds no such object."""
    empty = F.array().cast("array<variant>")
    items = lambda value: F.coalesce(F.try_variant_get(value, "$.items", "array<variant>"), empty)
    return once(F.try_parse_json(plain_punctuation(json_block(response))), lambda value: F.when(_kind(value).startswith("OBJECT"), items(value)))


def entry_error(item: Column, n_options: int = 5) -> Column:
    """Why an item of a quiz can't be used; null if it can."""
    allowed = [chr(65 + k) for k in range(n_options)]
    named = ", ".join(f"'{letter}'" for letter in allowed)
    error = F.when(~_kind(item).startswith("OBJECT"), "not an object")
    for field in ("question", "options", "answer", "explanation"):
        error = error.when(_kind(item, f"$.{field}") == "", f"Missing field: {field}")
    options = F.try_variant_get(item, "$.options", "array<variant>")
    answer = F.upper(strip(F.coalesce(F.try_variant_get(item, "$.answer", "string"), F.lit("none"))))
    wrong = once(answer, lambda a: F.when(~a.isin(allowed), F.concat(F.lit(f"Answer must be one of [{named}], got "), a)))
    return error.when(F.coalesce(F.size(options), F.lit(-1)) != n_options, f"Options must have exactly {n_options}").otherwise(wrong)
