"""Quality rules as weak supervision, in DataFrame operations only.

Every rule looks at counts of one text and votes that it is good, votes that
it is bad, or abstains.  Expectation-maximisation over the votes of all
documents estimates how often documents are good and how often each rule is
right about good and about bad ones; a document is kept if the posterior
probability that it is good reaches one half.  Documents with the same votes
are one case, so an iteration is an aggregation over at most 3^rules rows, and
only the few parameters come to the driver between iterations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.tables import written

#: The white space that parts words, and the signs that count as symbols.
SPACES, SIGNS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_BLANKS = r" \t\u000b\u000c\r"  # in SQL
WINDOW = 8
#: Change of any parameter at which the iterations end.
SETTLED = 1e-6
#: Prior belief, worth BELIEF documents at every size: four of five documents are good; a rule rarely votes against a
#: good one, and finds about a seventh of the bad ones.  Two limits keep the classes from changing their names: more
#: than half of the documents are good, and a rule that votes on good documents is right at least half of the time.
BELIEF, GOOD, RIGHT, LEAST = 20.0, 0.8, {"good": 0.97, "bad": 0.15}, 0.5
THRESHOLD = 0.5


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, null (abstain) otherwise or where the value is null."""
    return F.when(value.isNull(), None).when(bad, 0).when(good, 1).cast("int")


def rules() -> dict[str, Column]:
    """The votes, from the columns of ``counts``."""
    length, signs = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    lines, repeats = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    upper, letters = _share("n_upper", "n_letters"), _share("n_letters", "word_chars")
    variety, marks = _share("n_distinct_words", "n_words"), _share("n_marks", "n_words")
    bare = _share("n_bare_words", "n_words")
    words = F.col("n_words")
    return {
        "v_length": _vote(words, words >= 40, words < 20),
        "v_word_length": _vote(length, length.between(3, 10), (length < 2) | (length > 15)),
        "v_symbols": _vote(signs, signs <= 0.02, signs > 0.1),
        "v_dup_lines": _vote(lines, lines <= 0.1, lines > 0.4),
        "v_repeats": _vote(repeats, repeats <= 0.1, repeats > 0.3),
        "v_upper": _vote(upper, upper <= 0.2, upper > 0.4),
        "v_letters": _vote(letters, letters >= 0.85, letters < 0.7),
        "v_variety": _vote(variety, (variety >= 0.4) | (words >= 2000), (variety < 0.2) & (words < 2000)),
        "v_marks": _vote(marks, marks <= 0.1, marks > 0.5),
        "v_bare": _vote(bare, bare <= 0.05, bare > 0.15),
    }


#: Names of the votes, in the order of ``rules``.
VOTES = (
    "v_length", "v_word_length", "v_symbols", "v_dup_lines", "v_repeats", "v_upper", "v_letters", "v_variety", "v_marks",
    "v_bare",
)

_HASHES = f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))"
#: Places of the windows that stand in the text twice or more: equal neighbours in sorted order.
_PLACES = (
    "array_sort(transform(flatten(transform(array(array_sort(transform(hashes, (h, i) -> struct(h, i)))), s -> "
    "filter(s, (e, k) -> coalesce(get(s, k - 1).h = e.h, false) or coalesce(get(s, k + 1).h = e.h, false)))), e -> e.i))"
)
_COVERED = (
    f"aggregate({_PLACES}, struct(0 as total, -{WINDOW} as last), "
    f"(a, i) -> struct(a.total + least({WINDOW}, i - a.last) as total, i as last), a -> a.total)"
)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append what the rules look at; all of it counts over the whole text, a null text being empty.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with
    a word), n_dup_lines (those equal to an earlier line), n_repeat_words
    (words in 8-word windows found twice or more), n_distinct_words, n_letters,
    n_upper, n_marks ("!" and "?"), n_bare_words (without a letter or digit).  Columns of these names are replaced.
    """
    names = (
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
        "n_letters", "n_upper", "n_marks", "n_bare_words", "words", "lines", "hashes",
        "_whole", "_plain", "_letters",
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = whole
    for space in SPACES[1:]:  # replace() leaves a string without the sign as it is; translate() builds every character anew
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    count = lambda signs: (F.length("_whole") - F.length(F.regexp_replace("_whole", f"[{signs}]+", ""))).cast("long")
    docs = docs.drop(*(set(names) - {text}))
    kept = docs.columns
    found = docs.select(*kept, whole.alias("_whole"), plain.alias("_plain"), F.regexp_replace(whole, r"\P{L}+", "").alias("_letters"))
    found = found.select(
        *kept,
        F.array_remove(F.split("_plain", " "), "").alias("words"),
        F.expr(f"filter(split(_whole, '\\n'), x -> btrim(x, '{_BLANKS}') <> '')").alias("lines"),
        F.length(F.replace("_plain", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        count(SIGNS).alias("n_symbols"),
        F.length("_letters").cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_letters", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        count("!?").alias("n_marks"),
        F.regexp_count("_plain", F.lit(r"(?:\A| )[^\p{L}\p{N} ]+(?= |\z)")).cast("long").alias("n_bare_words"),
    )
    found = found.withColumn("hashes", F.when(F.size("words") >= WINDOW, F.expr(_HASHES)).otherwise(F.expr("array()")))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return found.select(
        *kept, "word_chars", "n_symbols", "n_letters", "n_upper", "n_marks", "n_bare_words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.when(repeated, F.expr(_COVERED)).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def posterior(model: dict[str, float]) -> Column:
    """Probability that a row with the columns VOTES is good."""
    logit = F.lit(math.log(model["good"] / (1 - model["good"])))
    for v in VOTES:
        a, b = model[f"{v}_good"], model[f"{v}_bad"]
        yes, no = math.log(a / (1 - b)), math.log((1 - a) / b)
        logit = logit + F.when(F.col(v) == 1, yes).when(F.col(v) == 0, no).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def fit(votes: DataFrame, belief: float = BELIEF) -> dict[str, float]:
    """Estimated share of good documents ("good") and, for each rule, how often
    it is right about good ones ("<rule>_good") and bad ones ("<rule>_bad").

    ``votes`` has the columns VOTES; every row counts.  ``belief`` is the weight
    of the prior belief, in documents.  Iterates until no parameter changes by
    SETTLED.  With no rows, or for a rule that never votes, the prior belief
    stands.
    """
    cases = written(votes.groupBy(*VOTES).agg(F.count("*").alias("n")).coalesce(1))
    model = {"good": GOOD} | {f"{v}_{k}": RIGHT[k] for v in VOTES for k in RIGHT}
    while True:
        q = F.col("q")
        sums = [F.sum(F.col("n") * q).alias("good"), F.sum(F.col("n").cast("double")).alias("all")]
        for v in VOTES:
            for k, weight, right in (("good", q, 1), ("bad", 1 - q, 0)):
                voted = F.when(F.col(v).isNotNull(), F.col("n") * weight)
                sums += [F.sum(voted).alias(f"{v}_{k}_all"), F.sum(F.when(F.col(v) == right, F.col("n") * weight)).alias(f"{v}_{k}")]
        row = cases.withColumn("q", posterior(model)).agg(*sums).first().asDict()
        seen = lambda name, row=row: row[name] or 0.0
        after = {"good": max(LEAST, (seen("good") + belief * GOOD) / (seen("all") + belief))}
        for v in VOTES:
            for k, right in RIGHT.items():
                after[f"{v}_{k}"] = (seen(f"{v}_{k}") + belief * right) / (seen(f"{v}_{k}_all") + belief)
            after[f"{v}_good"] = max(LEAST, after[f"{v}_good"])
        change = max(abs(after[k] - model[k]) for k in model)
        model = after
        if change < SETTLED:
            return model


def judge(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append the counts, every rule's vote, ``base_failed``, ``quality`` and ``kept``.

    ``base_failed`` is true for fewer than 20 words or more than 30 % repeated
    words; ``quality`` is the posterior probability of being good, and
    ``kept`` is false if base_failed, else whether quality reaches the
    threshold.  A null or word-less text is base_failed.  Rows are never
    dropped, repeated rows count each; an empty table gives no rows.  Columns
    that have these names are replaced; the text is not returned.
    """
    table = counts(docs, text).drop(text, *VOTES, "base_failed", "quality", "kept")
    voted = written(table.select("*", *(c.alias(name) for name, c in rules().items())))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = voted.withColumns({"base_failed": failed, "quality": posterior(fit(voted.select(*VOTES)))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        F.col("doc_id").cast("long"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
