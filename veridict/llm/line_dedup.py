"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is compared as its sequence of words.  It is removed if an earlier line
(by document id, then line number) has the same words, or is one edit away
that touches an eighth of it at most; the earliest line stays.  An edit inserts,
leaves out or replaces one unit: a word in lines of eight words or more, a
character (of the words with one blank between them) in lines of eight words
or fewer that have eight characters or more.  Lines of exactly eight words are
compared both ways, so no pair falls between the two.

All variants of a line with one unit left out are hashed and joined.  Equal
variants with the same place left out are lines with one unit replaced; a
whole line equal to another's variant is that line with one unit inserted (a
variant is hashed as what is before and after the gap, so the whole line
stands with a gap at each place).  Edit distance is then verified on the
units.  One edit leaves the first or the last half of a line as it is: a line
none of whose halves occurs in another line has no neighbour and emits
nothing, and others emit variants of the other half only.

Every group is reduced to its earliest member by an aggregation with map-side
combining and joined back.  In these joins the few keys that hold many rows
are taken out and met without a shuffle, or spread by a salt, so a line or a
variant that a third of all lines share is never gathered in a task, and never
are all pairs of a group formed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.tables import join_frequent, join_salted, written

#: Fewest units of a line that one edit may tell from another.
MIN_UNITS = 8
#: Units that are hashed in one chain; chains of longer lines are made of such pieces.
PIECE = 64
_FLAGS = ("f1", "f2", "f3", "f4")


@dataclass
class Places:
    """How rows and lines are numbered: ``row`` is an expression of _doc and _text, a multiple of ``step``.

    A line's place is its row plus its number, so places ascend by id and
    line.  They are longs where ids are unique and the range of ids and the
    longest text leave room, else decimals in which a hash of the text tells
    rows that share an id apart.
    """

    row: str
    step: int


def _places(slim: DataFrame) -> Places:
    hashed = F.xxhash64("_text")
    each = slim.groupBy("_doc").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"), F.max(F.octet_length("_text")).alias("n"))
    seen = each.agg(F.bool_or(F.col("a") != F.col("b")).alias("shared"), F.min("_doc").alias("low"), F.max("_doc").alias("high"), F.max("n").alias("n")).first()
    bits = (seen.n or 0).bit_length() + 1
    if not seen.shared and max(abs(seen.low or 0), abs(seen.high or 0)) < 1 << (62 - bits):
        return Places(f"cast(_doc as bigint) * {1 << bits}", 1 << bits)
    step = 1 << 31
    wide = f"cast(_doc as decimal(20,0)) * {step} + shiftrightunsigned(xxhash64(_text), 33)"
    return Places(f"cast(cast({wide} as decimal(28,0)) * {step} as decimal(38,0))", step)


def _lines_of(text: str) -> str:
    """SQL for the lines of a text with blanks for all other white space."""
    for sign in ("\\t", "\\u000b", "\\u000c", "\\r"):  # replace() leaves a string without the sign as it is
        text = f"replace({text}, '{sign}', ' ')"
    return f"split({text}, '\\n')"


def _words(line: str) -> str:
    """SQL for the words of such a line."""
    return f"array_remove(split({line}, ' '), '')"


def _units(words: str) -> str:
    """SQL for the characters of a line."""
    return f"split(array_join({words}, ' '), '')"


def _halves(n: str, units: str) -> list[str]:
    """SQL for hashes of a line's halves, and of the half that it has only if it has got one unit more.

    A line of n units is cut as a line of n units and as one of n - 1 units
    that has got one more; of the four halves one is in both cuts.
    """
    other = f"if({n} % 2 = 1, xxhash64(slice({units}, {n} div 2 + 2, {n})), xxhash64(slice({units}, 1, {n} div 2 - 1)))"
    return [
        f"xxhash64(slice({units}, 1, {n} div 2))", f"xxhash64(slice({units}, {n} div 2 + 1, {n}))", f"if({n} > {MIN_UNITS}, {other}, null)",
    ]


def _keys(n: str, halves: tuple[str, str, str], view: int) -> list[str]:
    """SQL for four keys that name the cut and the half; null where the line is too short for them."""
    a, b, c = halves
    odd = f"{n} % 2 = 1"
    return [
        f"if({n} >= {MIN_UNITS}, xxhash64({view}, 1, {n}, {a}), null)",
        f"if({n} >= {MIN_UNITS}, xxhash64({view}, 2, {n}, {b}), null)",
        f"if({n} > {MIN_UNITS}, xxhash64({view}, 1, {n} - 1, if({odd}, {a}, {c})), null)",
        f"if({n} > {MIN_UNITS}, xxhash64({view}, 2, {n} - 1, if({odd}, {c}, {b})), null)",
    ]


def _lines(slim: DataFrame, places: Places) -> DataFrame:
    """(_place, h1, h2, k1..k8) of every line with words: what it is, the keys of its halves in words and in characters."""
    words = F.expr(f"transform({_lines_of('_text')}, x -> {_words('x')})")
    split = slim.select(F.expr(places.row).alias("_row"), F.posexplode(words).alias("_line", "_words"))
    split = split.select((F.col("_row") + F.col("_line")).alias("_place"), "_words", F.size("_words").alias("n")).where("n > 0")
    short = split.withColumn("_chars", F.expr(f"if(n <= {MIN_UNITS}, {_units('_words')}, array())")).withColumn("m", F.size("_chars"))
    hashed = short.select(
        "_place", "n", "m", *(F.expr(h).alias(c) for h, c in zip(_halves("n", "_words"), "abc", strict=True)),
        *(F.expr(f"if(m >= {MIN_UNITS}, {h}, null)").alias(c) for h, c in zip(_halves("m", "_chars"), "def", strict=True)),
    )
    keys = _keys("n", ("a", "b", "c"), 0) + _keys("m", ("d", "e", "f"), 1)
    return hashed.select(
        "_place", F.xxhash64("n", "a").alias("h1"), F.xxhash64("n", "b").alias("h2"), *(F.expr(k).alias(f"k{i + 1}") for i, k in enumerate(keys))
    )


def _chain(units: str) -> str:
    """SQL for hashes of the first 0, 1, ... n units, in time that grows little faster than n.

    Pieces of PIECE units are hashed each from its own beginning; a prefix is
    hashed as the pieces before its end and the beginning of the last one.
    """
    grow = "aggregate({0}, array({1}L), (a, w) -> concat(a, array(xxhash64(element_at(a, -1), {2}))))"
    pieces = f"transform(sequence(0, (size({units}) - 1) div {PIECE}), k -> {grow.format(f'slice({units}, k * {PIECE} + 1, {PIECE})', 0, 'w')})"
    heads = grow.format("x", 42, "element_at(w, -1)")
    both = f"transform(array({pieces}), x -> struct(x as x, {heads} as h))[0]"
    joined = (
        f"transform(array({both}), c -> transform(sequence(0, size({units})), "
        f"i -> xxhash64(get(c.h, i div {PIECE}), coalesce(get(get(c.x, i div {PIECE}), i % {PIECE}), 0L))))[0]"
    )
    one = f"transform({grow.format(units, 0, 'w')}, x -> xxhash64(42L, x))"
    return f"if(size({units}) < {PIECE}, {one}, {joined})"


def _emitted() -> str:
    """SQL for an array of (key, kind) of a line's variants, from n, p, s and the halves it shares.

    p[i] is the hash of the first i units, s[i] of the last i; only places in
    the half that the lines met do not have in common are left out.
    """
    several = [
        ("n - 1", "f1 and i >= n div 2 or f2 and i < n div 2", "'replaced', view, i, p[i], s[n - 1 - i]", 0),
        ("n - 1", "f3 and i >= (n - 1) div 2 or f4 and i <= (n - 1) div 2", "'inserted', view, p[i], s[n - 1 - i]", 1),
        ("n", "f1 and i >= n div 2 or f2 and i <= n div 2", "'inserted', view, p[i], s[n - i]", 2),
    ]
    parts = [
        f"transform(filter(sequence(0, {last}), i -> {where}), i -> struct(xxhash64({key}) as k, cast({kind} as tinyint) as kind))"
        for last, where, key, kind in several
    ]
    return f"concat({', '.join(parts)})"


def _near(slim: DataFrame, distinct: DataFrame, places: Places) -> DataFrame:
    """_place of the distinct lines that are one edit from an earlier one.

    ``distinct`` has one row for each different line: its first place and the
    keys of its halves.
    """
    keys = F.posexplode(F.array(*(f"k{i + 1}" for i in range(8)))).alias("w", "k")
    halves = distinct.select("_place", keys).where("k is not null")
    met = written(halves.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"))
    found = join_frequent(halves, met, "k").withColumn("view", F.expr("cast(w div 4 as tinyint)"))
    alive = found.groupBy("_place", "view").agg(*(F.bool_or(F.col("w") % 4 == i).alias(f) for i, f in enumerate(_FLAGS)))
    line = F.expr(f"pmod(_place, {places.step})")
    alive = alive.withColumn("_line", line.cast("int")).withColumn("_row", F.col("_place") - line)
    wanted = alive.groupBy("_row").agg(F.collect_list(F.struct("_place", "_line", "view", *_FLAGS)).alias("_wanted"))
    # at most the lines of one document in an array; a row that comes twice emits the same places twice, which changes nothing
    texts = slim.select(F.expr(places.row).alias("_row"), "_text").join(wanted, "_row")
    lines = texts.select(F.explode("_wanted").alias("e"), F.expr(_lines_of("_text")).alias("_all")).select("e.*", "_all")
    lines = lines.withColumn("_words", F.expr(_words("get(_all, _line)"))).drop("_all", "_line")
    lines = lines.withColumn("_units", F.expr(f"if(view = 0, _words, {_units('_words')})")).drop("_words")
    lines = lines.select("*", F.size("_units").alias("n"), F.expr(_chain("_units")).alias("p"), F.expr(_chain("reverse(_units)")).alias("s"))
    lines = written(lines.select("_place", "view", "_units", F.expr(_emitted()).alias("_emitted")))
    rows = lines.select("_place", "view", F.explode("_emitted").alias("e")).select("_place", "view", "e.k", "e.kind")
    lowest = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("_place")))
    groups = rows.groupBy("k").agg(
        F.count("*").alias("c"), lowest(0).alias("replaced"), lowest(1).alias("longer"), lowest(2).alias("shorter")
    ).where("c > 1 and (replaced is not null or longer is not null and shorter is not null)")
    partner = F.when(F.col("kind") == 0, F.col("replaced")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = join_frequent(rows, written(groups), "k").select("_place", "view", partner.alias("_first"))
    pairs = written(pairs.where("_first < _place").distinct())
    own = lines.select("_place", "view", F.col("_units").alias("x"))
    other = lines.select(F.col("_place").alias("_first"), "view", F.col("_units").alias("y"))
    both = join_salted(pairs.join(own, ["_place", "view"]), other, ["_first", "view"], pairs)
    return both.where(within_one_edit("x", "y")).select("_place").distinct()


def within_one_edit(x: str, y: str) -> Column:
    """Whether two arrays differ by one element at most: what they share at both ends leaves no more."""
    same = "array_position(zip_with({0}, {1}, (a, b) -> coalesce(a = b, false)), false)"
    shared = lambda a, b: f"if({same.format(a, b)} = 0, greatest(size({x}), size({y})), {same.format(a, b)} - 1)"
    ends = f"{shared(x, y)} + {shared(f'reverse({x})', f'reverse({y})')}"
    return F.expr(f"{ends} >= greatest(size({x}), size({y})) - 1")


def removed_lines(slim: DataFrame, places: Places) -> DataFrame:
    """_place of every line that repeats an earlier one; ``slim`` has _doc and _text, none null."""
    lines = written(_lines(slim, places))
    distinct = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("c"), F.min("_place").alias("_first"), *(F.max(f"k{i + 1}").alias(f"k{i + 1}") for i in range(8))
    )
    distinct = written(distinct)
    repeated = distinct.where("c > 1").select("h1", "h2", "c", "_first")
    exact = join_frequent(lines.select("_place", "h1", "h2"), repeated, ["h1", "h2"]).where("_place <> _first").select("_place")
    firsts = distinct.where("k1 is not null or k5 is not null").withColumnRenamed("_first", "_place")
    return exact.unionByName(_near(slim, firsts, places))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """All rows of ``docs`` with repeated lines taken out of the text, and their number appended.

    Words are parted by ASCII white space and compared as they are.  Lines
    without words never repeat and always stay.  A text that loses no line is
    returned unchanged, a null text as null; one that loses all lines becomes
    empty; no row is dropped.  Ids are whole numbers.  Rows that share an id
    come in the order of a hash of their text and are cut each for itself;
    rows that share id and text count as one and are cut alike.  A row with a
    null id is returned unchanged and compared with nothing.  A column named as
    ``removed`` is replaced; all others are kept.
    """
    docs = docs.drop(removed)
    slim = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_doc is not null and _text <> ''")
    places = _places(slim)
    line = F.expr(f"pmod(_place, {places.step})")
    gone = removed_lines(slim, places).select((F.col("_place") - line).alias("_row"), line.cast("int").alias("_line"))
    gone = gone.groupBy("_row").agg(F.collect_set("_line").alias("_gone"))
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    joined = keyed.withColumn("_key", F.expr(places.row)).join(gone, F.col("_key") == F.col("_row"), "left")
    joined = joined.withColumn("_gone", F.when(F.col("_text") != "", F.col("_gone")))
    kept = F.expr("transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> get(_lines, i))")
    joined = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n")))
    whole = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    columns = [(whole if c == text else F.col(n)).alias(c) for c, n in names.items()]
    return joined.select(*columns, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(removed))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that repeat an earlier line of the corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_removed")
