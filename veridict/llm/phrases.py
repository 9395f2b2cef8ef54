"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word of a piece with the words
that lead after it, padded where the piece ends.  Spark's ROLLUP over these
columns then gives the counts of all shorter phrases as sums over their longer
windows, so single words and shorter n-grams are never exploded on their own.

Windows hold 64-bit ids of words.  That no two words share an id is checked
against the table of all words, which is counted first; if two did, ids would
be made anew from another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.llm.tables import HOT_KEYS, HOT_ROWS, forget, written
from veridict.llm.words import _LOWER, _tables, chunks, mix64, signed, text_buffer

#: Distinct windows and words that a task combines before it sends them on.
WINDOWS, WORDS = 1 << 21, 1 << 19
#: Parts into which the windows that begin with two very frequent words are dealt, by their third word.
SALTS = 64
SEEDS = 5

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK


def _lang_seed(lang: str, seed: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8, salt=str(seed).encode()).digest(), dtype=np.uint64)[0]


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """For whole texts at a time: lower-cased bytes, starts, ends, ids and pieces of the words, and each word's language."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    for batch in batches:
        raw, bounds = text_buffer(batch.column(0))
        langs = batch.column(1).dictionary_encode()
        names = langs.dictionary.to_pylist()
        seeds = np.array([_lang_seed(x, seed) for x in names], dtype=np.uint64)
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for a, b in chunks(bounds):
            buf = _LOWER[raw[bounds[a] : bounds[b]]]
            cuts = bounds[a : b + 1] - bounds[a]
            kind = _KIND[buf]
            inside, edge = np.zeros(len(buf) + 2, bool), np.zeros(len(buf) + 1, bool)
            inside[1:-1] = kind == _WORD
            edge[cuts] = True
            starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
            ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
            powers, inverses = _tables(len(buf) + 1)
            sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(values[buf] * powers[:-1], out=sums[1:])
            owner = np.searchsorted(cuts, starts, "right") - 1
            own = codes[a:b][owner]
            ids = mix64(mix64((sums[ends] - sums[starts]) * inverses[starts]) + seeds[own])
            ids[ids == 0] = 1
            breaks = np.cumsum(kind == _BREAK)
            pieces = (breaks[starts] if len(starts) else starts) + owner
            yield buf, starts, ends, ids, pieces, (own, names)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ranges one after the other, and where each begins."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def _distinct_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def combined() -> pa.RecordBatch:
            names = sorted({x for part in held for x in part[4]})
            code = {x: i for i, x in enumerate(names)}
            langs = np.concatenate([np.array([code[x] for x in part[4]], dtype=np.int32)[part[3]] for part in held])
            ids, sizes = np.concatenate([part[0] for part in held]), [len(part[2]) for part in held]
            base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            starts = np.concatenate([part[1][:-1] + b for part, b in zip(held, base, strict=True)])
            ends = np.concatenate([part[1][1:] + b for part, b in zip(held, base, strict=True)])
            counts = np.concatenate([part[5] for part in held])
            _, first, which = np.unique(ids, return_index=True, return_inverse=True)
            data, offsets = _slices(np.concatenate([part[2] for part in held]), starts[first], ends[first])
            text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
            total = np.bincount(which, counts).astype(np.int64)
            lang = pa.DictionaryArray.from_arrays(pa.array(langs[first]), pa.array(names)).cast(pa.string())
            return pa.record_batch([pa.array(signed(ids[first])), lang, text.cast(pa.string()), pa.array(total)], names=["id", "lang", "word", "c"])

        for buf, starts, ends, ids, _, (own, names) in _words(batches, seed):
            if not len(ids):
                continue
            unique, first, counts = np.unique(ids, return_index=True, return_counts=True)
            data, offsets = _slices(buf, starts[first], ends[first])
            held.append((unique, offsets, data, own[first], names, counts))
            count += len(unique)
            if count >= WORDS:
                yield combined()
                held, count = [], 0
        if held:
            yield combined()

    return run


def _counted_windows(longest: int, seed: int, hot: np.ndarray):
    names = [*(f"w{j + 1}" for j in range(longest)), "part", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def combined() -> pa.RecordBatch:
            columns = np.concatenate(held, axis=1)
            # equal windows come next to each other, and windows with the same first words too
            key = (columns[0] >> np.uint64(40)) << np.uint64(40) | (columns[1] >> np.uint64(44)) << np.uint64(20)
            if longest > 2:
                key |= columns[2] >> np.uint64(44)
            columns = columns[:, np.argsort(key, kind="stable")]
            new = np.flatnonzero(np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)]))
            counts = np.diff(np.concatenate([new, [columns.shape[1]]]))
            columns = columns[:, new]
            part = np.zeros(len(new), dtype=np.int32)
            if longest > 2 and len(hot):
                both = np.isin(columns[0], hot) & np.isin(columns[1], hot)
                part[both] = 1 + (columns[2][both] % np.uint64(SALTS)).astype(np.int32)
            return pa.record_batch([*(pa.array(signed(c)) for c in columns), pa.array(part), pa.array(counts)], names=names)

        for _, _, _, ids, pieces, _ in _words(batches, seed):
            if not len(ids):
                continue
            columns = np.zeros((longest, len(ids)), dtype=np.uint64)
            columns[0] = ids
            for j in range(1, min(longest, len(ids))):
                columns[j, :-j] = np.where(pieces[j:] == pieces[:-j], ids[j:], np.uint64(0))
            held.append(columns)
            count += len(ids)
            if count >= WINDOWS:
                yield combined()
                held, count = [], 0
        if held:
            yield combined()

    return run, ", ".join(f"{x} bigint" for x in names[:-2]) + ", part int, c bigint"


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """All words by language with their counts and ids (``id, lang, word, c``, written), and the seed of the ids."""
    slim = _slim(docs, text, lang)
    for seed in range(SEEDS):
        found = slim.mapInArrow(_distinct_words(seed), "id bigint, lang string, word string, c bigint")
        words = written(found.groupBy("id", "lang", "word").agg(F.sum("c").alias("c")))
        if words.count() == words.select("id").distinct().count():
            return words, seed
        forget(words)
    raise ValueError("words share ids whatever the seed")


def _slim(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(docs[text].cast("string").alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """Ids ``w1``, ``w2`` ... (null past the end) of all phrases of up to ``longest`` words that occur ``least`` times, and ``f``.

    Windows that occur less often only matter for their beginnings: they are
    padded from the first prefix that is rare, before ROLLUP sums the prefixes.
    """
    total = words.agg(F.sum("c")).first()[0] or 0
    hot = words.where(F.col("c") > max(HOT_ROWS, total // HOT_KEYS)).select("id").collect()  # at most HOT_KEYS
    run, schema = _counted_windows(longest, seed, np.array([r["id"] for r in hot], dtype=np.int64).view(np.uint64))
    columns = [f"w{j + 1}" for j in range(longest)]
    windows = _slim(docs, text, lang).mapInArrow(run, schema)
    # all windows that begin with the same two words meet in one task, if these are very frequent in one of SALTS
    dealt = windows.repartition("w1", "w2", "part").groupBy("w1", "w2", "part", *columns[2:]).agg(F.sum("c").alias("c"))
    enough = {longest: F.col("c") >= least}
    for j in range(longest - 1, 1, -1):
        prefix = Window.partitionBy("w1", "w2", "part", *columns[2:j])
        dealt = dealt.withColumn(f"n{j}", F.sum("c").over(prefix))
        enough[j] = F.col(f"n{j}") >= least
    if longest > 2:
        enough[2] = enough[2] | (F.col("part") > 0)
    padded = dealt.select("w1", *(F.when(enough[j], F.col(f"w{j}")).otherwise(0).alias(f"w{j}") for j in range(2, longest + 1)), "c")
    summed = padded.groupBy(*columns).agg(F.sum("c").alias("c"))
    rolled = summed.rollup(*columns).agg(F.sum("c").alias("f"))
    return rolled.where((F.col("f") >= least) & (F.coalesce(*reversed(columns)) != 0))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends
    and into words at spaces and tabs; a phrase lies within one piece.  A phrase
    of 2 to ``longest`` words that occurs a >= ``least`` times scores
    floor(1000000 a^2 / (l r)) at its lowest-scoring cut into parts that occur l
    and r times; it is dropped if a longer such phrase holds it and occurs
    ``inside`` per cent as often.  Equal scores are ordered by a, then by the
    phrase's bytes.  A null text is empty, a null language is ``und``; repeated
    rows count each; an empty table gives no rows.  Counts up to 10^12 are exact.
    """
    words, seed = vocabulary(docs, text, lang)
    counts = written(phrase_counts(docs, words, seed, longest, least, text, lang))
    columns = [f"w{j + 1}" for j in range(longest)]

    def of_length(k: int, first: int = 1, to: str = "f") -> DataFrame:
        """Phrases of k words, as columns from w<first> on."""
        rows = counts.where(F.col(columns[k - 1]).isNotNull() & (F.col(columns[k]).isNull() if k < longest else F.lit(True)))
        return rows.select(*(F.col(columns[j]).alias(f"w{first + j}") for j in range(k)), F.col("f").alias(to))

    kept = []
    for size in range(2, longest + 1):
        phrases = of_length(size, to="a")
        cuts = []
        for k in range(1, size):
            phrases = phrases.join(of_length(k, to="l"), columns[:k]).join(of_length(size - k, first=k + 1, to="r"), columns[k:size])
            a, lower, right = (F.col(x).cast(f"decimal({p},0)") for x, p in (("a", 12), ("l", 15), ("r", 15)))
            phrases = phrases.withColumns({"num": F.lit(1_000_000).cast("decimal(7,0)") * (a * a), "den": lower * right})
            cut = F.struct(F.expr("num div den").alias("score"), F.lit(k).alias("k"), "l", "r")
            phrases = phrases.withColumn(f"cut{k}", cut).drop("l", "r", "num", "den")
            cuts.append(F.col(f"cut{k}"))
        phrases = phrases.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        parts = [
            of_length(longer).select(*(F.col(columns[o + j]).alias(columns[j]) for j in range(size)), "f")
            for longer in range(size + 1, longest + 1)
            for o in range(longer - size + 1)
        ]
        if parts:
            around = reduce(DataFrame.unionByName, parts).groupBy(*columns[:size]).agg(F.max("f").alias("around"))
            phrases = phrases.join(around, columns[:size], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a")))
        rest = [F.lit(None).cast("bigint").alias(c) for c in columns[size:]]
        kept.append(phrases.select(*columns[:size], *rest, "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    frequent = words.where(F.col("c") >= least)
    found = reduce(DataFrame.unionByName, kept).join(frequent.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = found.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
    for j in range(2, longest + 1):
        found = found.join(frequent.select(F.col("id").alias(f"w{j}"), F.col("word").alias(f"t{j}")), f"w{j}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *(f"t{j + 1}" for j in range(longest))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
