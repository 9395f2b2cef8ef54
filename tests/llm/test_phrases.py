"""Collocations against counting every n-gram."""

import collections
import random
import re

import duckdb
import pytest

from tests.llm.data import LOWER, SCHEMA, corpus
from veridict.llm import oracles, phrases

PIECES, WORDS = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")


def brute(rows, longest=3, least=10, inside=50, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for t, lang in rows:
        for piece in PIECES.split((t or "").translate(LOWER)):
            w = WORDS.findall(piece)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found, n = [], sum(c for p, c in f.items() if len(p) == 1)
        chosen = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        around = collections.Counter()
        for p, c in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], c)
        for p, a in chosen.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not around[p] or 100 * around[p] < inside * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(None, t, lang, None, 0, "c", "i", 1) for t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Few words, so that phrases repeat; breaks, case, blanks of all kinds, nulls, repeated and very long texts."""
    rng = random.Random(11)
    vocabulary = ["Ein", "zwei", "drei,", "vier", "fünf.", "six\t", "sept\n", "UN\x0b", "deux\x00", "中文", "naïve", "\x1c", "a" * 200, "x!y"]
    found = []
    for i in range(250):
        w = [rng.choice(vocabulary) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        found.append((" ".join(w), ["en", "de", None, "und"][i % 4]))
    found += [(" New york city hall " * 30, "en")] * 3 + [(None, "en"), (None, None), ("", "fr"), (" .\t, ", "fr"), ("word " * 5000, "de")]
    return found + [(t, "en") for _, t, *_ in corpus()]


@pytest.mark.parametrize("longest,least", [(3, 10), (2, 3), (4, 2), (5, 4)])
def test_against_counting(spark, rows, longest, least):
    got = phrases.collocations(table(spark, rows), longest, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, longest, least)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_small_parts_frequent_beginnings_and_top(spark, rows, monkeypatch):
    """Tasks that combine little, first words that count as very frequent, and a short list with ties."""
    monkeypatch.setattr(phrases, "WINDOWS", 50)
    monkeypatch.setattr(phrases, "WORDS", 20)
    monkeypatch.setattr(phrases, "HOT_ROWS", 5)
    monkeypatch.setattr(phrases, "HOT_KEYS", 50)
    got = phrases.collocations(table(spark, rows), 3, 2, top=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 2, top=7)


def test_ids_are_made_anew_when_words_share_one(spark, rows, monkeypatch):
    real = phrases._distinct_words

    def sharing(seed):
        run = real(seed)
        if seed:
            return run

        def shared(batches):
            for batch in run(batches):
                ids = batch.column(0).to_numpy() % 7
                yield phrases.pa.record_batch([phrases.pa.array(ids), *batch.columns[1:]], names=batch.schema.names)

        return shared

    monkeypatch.setattr(phrases, "_distinct_words", sharing)
    words, seed = phrases.vocabulary(table(spark, rows))
    assert seed == 1 and words.count() == words.select("id").distinct().count()


def test_long_words_and_counts(spark):
    rows = [("y" * 3000 + " " + "z" * 3000, None)] * 12
    assert sorted(map(tuple, phrases.collocations(table(spark, rows)).collect())) == brute(rows)


def test_empty_table(spark):
    assert phrases.collocations(table(spark, [("a", "b")]).where("false")).count() == 0
    assert phrases.collocations(table(spark, [(None, None), (" ", "en")])).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracles.PHRASES)
    got = phrases.op13_phrase_collocations(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
