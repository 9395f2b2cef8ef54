"""Scalar functions on labels, answers and model output, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f\x85\xa0]+"


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with x computed once a row: an expression that is named twice is computed twice, and nested ones multiply."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends (all kinds, not only spaces)."""
    return F.regexp_replace(x, rf"^{_BLANK}|{_BLANK}$", "")


def normalize_label(x: Column) -> Column:
    """Lower case, ``&`` as ``and``, runs of anything but a-z and 0-9 as one space."""
    plain = F.regexp_replace(F.replace(F.lower(strip(x)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.trim(plain)


def is_combined_label(x: Column) -> Column:
    """Whether a label names two topics: a slash, or the word "and" between others."""
    return F.contains(x, F.lit("/")) | F.contains(normalize_label(x), F.lit(" and "))


def collapse_slashes(x: Column) -> Column:
    return F.regexp_replace(x, r"\s*/\s*", "/")


def collapse_space(x: Column) -> Column:
    """Lower case with white space collapsed, for joining topic labels."""
    return F.lower(strip(F.regexp_replace(x, r"\s+", " ")))


def json_block(x: Column) -> Column:
    """An object or array in a json fence, else the widest stretch from a bracket to its last counterpart, else the text."""
    fenced = lambda x: F.regexp_extract(x, r"(?s)```json\s*(\{.*\}|\[.*\])\s*```", 1)
    bare = lambda x: F.regexp_extract(x, r"(?s)(\{.*\}|\[.*\])", 1)
    either = lambda found, other: once(found, lambda f: F.when(f != "", strip(f)).otherwise(other))
    return once(x, lambda x: either(fenced(x), either(bare(x), strip(x))))


def _first_match(x: Column, patterns: tuple[str, ...]) -> Column:
    """First group of the first pattern that matches, null if none does."""
    return once(x, lambda x: F.coalesce(*(once(F.regexp_extract(x, p, 1), lambda f: F.when(f != "", f)) for p in patterns)))


def answer_letter(x: Column, allowed: str = "ABCDE") -> Column:
    """The letter a response chooses, null if none of ``allowed``.

    The first pattern that matches decides, even when its letter is not
    allowed; else the last single letter of the text in capitals.
    """
    #: The ways to state an answer, by priority.
    patterns = (
        r"(?iU)the\s+answer\s+is\s*\(?\s*([A-Z])\s*\)?",
        r"(?iU)\banswer\s*:\s*([A-Z])\b",
        r"(?U)\(([A-Z])\)\s*$",
    )
    stated = lambda x: F.upper(_first_match(strip(x), patterns))
    last = lambda x: F.try_element_at(F.regexp_extract_all(F.upper(x), F.lit(r"(?U)\b([A-Z])\b"), F.lit(1)), F.lit(-1))
    return once(x, lambda x: once(F.coalesce(stated(x), last(x)), lambda letter: F.when(F.instr(F.lit(allowed), letter) > 0, letter)))


def answer_letter_of_ten(x: Column) -> Column:
    """The letter A to J that a response to a ten-option question chooses."""
    #: The ways to state an answer, by priority.
    patterns = (
        r"answer is \(?([A-J])\)?",
        r"[aA]nswer:\s*([A-J])",
        r"best course of action to perform immediately is [\(\[]([A-J])[\)\]]",
        r"best course of action.*[\(\[]([A-J])[\)\]]",
        r"(?=.*\bbest\b)(?=.*\baction\b).*[\(\[]([A-J])[\)\]]",
    )
    return _first_match(x, patterns)


def repaired_options(x: Column) -> Column:
    """Options given as JSON text, typographic quotes made plain, without those that are "N/A"; null if it is no array."""
    parsed = F.from_json(F.translate(x, "“”’‘", "\"\"''"), "array<string>", {"mode": "PERMISSIVE"})
    return F.filter(parsed, lambda o: F.coalesce(o != "N/A", F.lit(True)))


def option_letters(n: Column) -> Column:
    """["A", "B", ...] of n letters."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.char(64 + i))).otherwise(F.array().cast("array<string>"))


def mcq_prompt(question: Column, options: Column) -> Column:
    """Question and lettered options, a line each."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(65 + i), F.lit(". "), o))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"))


def item_error(question: Column, options: Column, answer: Column, n_options: int = 5) -> Column:
    """Why a quiz item is not usable; null if it is."""
    place = F.ascii(strip(answer)) - 64
    return (
        F.when(question.isNull() | (strip(question) == ""), "missing question")
        .when(options.isNull(), "missing options")
        .when(F.size(options) != n_options, "wrong number of options")
        .when(answer.isNull() | (strip(answer) == ""), "missing answer")
        .when((F.length(strip(answer)) != 1) | ~place.between(1, n_options), "answer out of range")
    )


def provider_family(x: Column, mode: str = "family") -> Column:
    """Maker of a model by the beginning of its name; the name itself where none is known, or if ``mode`` is "exact".

    A missing or empty name is "unknown".
    """
    raw = F.when(x.isNull() | (x == ""), "unknown").otherwise(x)
    if mode == "exact":
        return raw
    #: Beginnings of model names and their makers.
    known = {"gpt-": "openai", "openai-": "openai", "claude-": "anthropic", "anthropic": "anthropic", "gemini-": "gemini", "google-": "gemini"}
    found = F.coalesce(*(F.when(F.startswith(F.lower(x), F.lit(start)), F.lit(maker)) for start, maker in known.items()))
    return F.coalesce(found, raw)


def _safe(x: Column, sign: str, ends: str) -> Column:
    safe = F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", sign)
    return F.regexp_replace(safe, f"^[{ends}]+|[{ends}]+$", "") if ends else safe


def safe_file_name(x: Column) -> Column:
    """Runs of other characters than letters, digits, dot, dash and underscore as one underscore."""
    return _safe(strip(x), "_", "")


def safe_suffix(x: Column) -> Column:
    """As a file name, without signs at both ends; a missing value is empty."""
    return _safe(strip(F.coalesce(x, F.lit(""))), "_", "_.-")


def safe_id(x: Column) -> Column:
    """As a suffix; "unknown" if nothing is left."""
    safe = safe_suffix(x)
    return F.when(safe == "", "unknown").otherwise(safe)


def model_slug(x: Column) -> Column:
    """Dashes instead of other characters, none at both ends; "model" if nothing is left."""
    slug = _safe(x, "-", "-")
    return F.when(slug == "", "model").otherwise(slug)


def custom_id(x: Column) -> Column:
    """An id of at most 64 safe characters; longer ones end in twelve digits of a digest of the whole."""
    safe = F.regexp_replace(x, r"[^a-zA-Z0-9_-]", "-")
    short = F.concat(F.substring(safe, 1, 64 - 12 - 1), F.lit("_"), F.substring(F.sha2(x.cast("binary"), 256), 1, 12))
    return F.when(F.length(safe) <= 64, safe).otherwise(short)


def plain_punctuation(x: Column) -> Column:
    """Typographic quotes, dashes and spaces as ASCII."""
    return F.translate(x, "‘’“”–— ", "''\"\"-- ")


def control_positions(x: Column) -> Column:
    """0-based places of control characters other than tab and line ends."""
    chars = F.split(x, "")
    places = F.transform(chars, lambda c, i: F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), i))
    return F.filter(places, lambda p: p.isNotNull())


def heat_level(v: Column, low: Column, high: Column) -> Column:
    """0 to 4 by place between low and high, half to even; null where there is no range or a value is missing or NaN."""
    v, low, high = (F.when(F.isnan(c.cast("double")), None).otherwise(c.cast("double")) for c in (v, low, high))
    share = (F.least(high, F.greatest(low, v)) - low) / F.when(high > low, high - low)
    return F.when(v.isNotNull() & (high > low), F.bround(share * 4, 0).cast("int"))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x.cast("double") * 100))


def correctness(x: Column) -> Column:
    """1 for the usual words for right, else 0."""
    word = F.lower(F.trim(x.cast("string")))
    return F.coalesce(word.isin("1", "1.0", "true", "t", "yes", "y", "correct"), F.lit(False)).cast("int")


def seed_of(name: Column) -> Column:
    """The number after the last "seed" in a name."""
    found = F.regexp_extract_all(name, F.lit(r"seed(\d+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def generator_of(name: Column, manifest: Column) -> Column:
    """The manifest's generator if it names one, else what stands between the first part and a last one that begins with "seed"."""
    parts = F.split(name, "_")
    own = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    fits = (F.size(parts) >= 3) & F.startswith(F.element_at(parts, -1), F.lit("seed")) & (own != "")
    return F.coalesce(F.when(manifest != "", manifest), F.when(fits, own), F.lit("unknown"))


def batch_tag(path: Column) -> Column:
    """The tag of the last path segment of the form quizzes_<tag>; null if there is none."""
    tags = F.regexp_extract_all(strip(path), F.lit(r"(?:^|/)quizzes_([^/]+)"), F.lit(1))
    tag = strip(F.try_element_at(tags, F.lit(-1)))
    return F.when(tag != "", tag)


def fraction(x: Column) -> Column:
    """Numbers above one are percentages; text that is no finite number is null."""
    v = x.try_cast("double")
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    return F.when(v > 1, v / 100).otherwise(v)


def surgical_panel(topic: Column) -> Column:
    """"surgical", "other" or, for everything else, "medicine"."""
    label = F.coalesce(collapse_space(topic), F.lit(""))
    #: Names of surgical specialties (parts, and whole ones) and of the other ones.
    parts, whole = ("surgery", "obstetrics", "gynecology", "obgyn"), ("otolaryngology", "urology", "ophthalmology")
    other = ("anesthesiology", "dermatology", "emergency medicine", "neurology", "radiation oncology", "psychiatry")
    return F.when(label.rlike("|".join(parts)) | label.isin(*whole), "surgical").when(label.isin(*other), "other").otherwise("medicine")


#: Short forms of topic labels.
SHORT_TOPICS = {
    "anesthesiology": "Anes", "critical care medicine": "CCM", "dermatology": "Derm", "emergency medicine": "EM", "endocrine": "Endo",
    "gastrointestinal": "GI", "general surgery": "Gen Surg", "hematology": "Heme", "infectious disease": "ID", "medical oncology": "Onc",
    "nephrology": "Nephro", "neurology": "Neuro", "neurological surgery": "NSG", "obstetrics and gynecology": "ObGyn",
    "ophthalmology": "Ophtho", "orthopedic surgery": "Ortho", "otolaryngology": "HEENT", "physical medicine and rehabilitation": "PM&R",
    "plastic surgery": "Plast Surg", "psychiatry": "Psych", "pulmonary": "Pulm", "radiation oncology": "Rad Onc",
    "rheumatology/musculoskeletal": "Rheum", "thoracic surgery": "Thor Surg", "urology": "Uro", "vascular surgery": "Vasc Surg",
    "geriatrics": "Geri", "pediatrics": "Peds", "cardiovascular": "Cards", "allergy/immunology": "All/Imm", "immunology": "Immuno",
    "cardiology": "Cards", "endocrinology": "Endo", "hematology/oncology": "Heme/Onc", "obstetrics": "Ob", "gynecology": "Gyn",
    "critical care": "CC", "unknown": "Unknown",
}


def short_topic(topic: Column) -> Column:
    """A label's short form, else the label with white space collapsed."""
    raw = strip(F.regexp_replace(F.coalesce(topic, F.lit("")), r"\s+", " "))
    forms = F.create_map(*(F.lit(x) for pair in SHORT_TOPICS.items() for x in pair))
    return F.coalesce(F.try_element_at(forms, F.lower(raw)), raw)


def is_blood_or_cancer(topic: Column) -> Column:
    """Whether a label names hematology and oncology together."""
    label = normalize_label(topic)
    return F.coalesce(F.contains(label, F.lit("hematology")) & F.contains(label, F.lit("oncology")), F.lit(False))


def blood_or_cancer(response: Column) -> Column:
    """"Hematology" or "Medical Oncology" as a response chooses; null if it doesn't."""
    text = strip(F.regexp_replace(strip(response), "^`+|`+$", ""))
    plain = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z ]+", " "), " +", " ")))
    first, whole = plain(F.get(F.split(text, r"\r\n|\r|\n"), F.lit(0))), plain(text)
    has = lambda word: F.contains(whole, F.lit(word))
    return (
        F.when(first == "hematology", "Hematology").when(first.isin("medical oncology", "oncology"), "Medical Oncology")
        .when(has("medical oncology"), "Medical Oncology").when(has("hematology") & ~has("oncology"), "Hematology")
        .when(has("oncology") & ~has("hematology"), "Medical Oncology")
    )


def quiz_id(at: Column, generator: Column, seed: Column) -> Column:
    """Id of a run: time in UTC to the millisecond, the generator as a file name, the seed."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd'T'HHmmssSSS'Z'"), safe_file_name(generator), F.concat(F.lit("seed"), seed.cast("string")))


def localized(path: Column, root: str, *anchors: str) -> Column:
    """A path recorded elsewhere, moved below ``root``: what begins with the first anchor folder it holds; null if it holds none."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    rest = F.coalesce(*(F.when(F.instr(plain, a) > 0, F.substring(plain, F.instr(plain, F.lit(a)), F.length(plain))) for a in anchors))
    return F.concat(F.lit(root.rstrip("/") + "/"), rest)


def jittered_ages(text: Column, *key: Column) -> Column:
    """Ages ("45-year-old", "45 yo") with up to 0.04 added, as "45.017 year-old".

    What is added belongs to the key and the match's place: uniform from 0 to
    0.04 and rounded to three digits, from the md5 of both.
    """
    #: Fixed value: how an age is written.
    pattern = r"(?iU)\b(\d+)(?:\s*[-\s]?)(?:year-old|year old|yo)\b"
    pieces, ages = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    named = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in key))

    def aged(age: Column, k: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", named, k.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        added = F.floor(bits * 80 / 2**32 / 2 + 0.5).cast("string")
        return F.concat(F.coalesce(age.try_cast("decimal(38,0)").cast("string"), age), F.lit("."), F.lpad(added, 3, "0"), F.lit(" year-old"))

    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p, k: F.concat(aged(ages[k], k), p))
    return F.when(F.size(ages) > 0, F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)
