"""Exact dedup against grouping by the whole text."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, corpus
from veridict.llm import exact_dedup, oracles, tables

RUNS = re.compile("[\x20\x09-\x0d]+")


def brute(rows):
    """Rows as (id, keep_id, group_size), and how many stay."""
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[RUNS.sub(" ", t or "")].append(i)
    least = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    return sorted(((i, least[t], len(ids)) for t, ids in groups.items() for i in ids), key=str), len(groups)


def stored(spark, rows, path, schema=SCHEMA, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("append").parquet(str(path))
    return spark.read.parquet(str(path))


def checked(got, rows):
    found = got.collect()
    want, stay = brute(rows)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in found), key=str) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == stay and all(r.id == r.keep_id for r in kept)
    assert len({bytes(r.digest) for r in kept}) == stay


@pytest.fixture(scope="module")
def rows():
    found = corpus()
    texts = [r[1] for r in found]
    more = [(None, texts[3]), (None, texts[3]), (70, texts[1]), (70, texts[1]), (71, f"\t{texts[1]}".replace(" ", "\r\n ")), (72, f" {texts[1]}"), (None, "alone"), (73, ""), (74, None)]
    return found + [(i, t, None, None, None, None, None, None) for i, t in more]


def test_against_grouping_with_nulls_ties_and_long_texts(spark, rows, tmp_path):
    checked(exact_dedup.dedup(stored(spark, rows, tmp_path / "docs")), rows)


def test_digests_that_clash_are_told_apart_by_bytes(spark, rows, tmp_path):
    docs = stored(spark, rows, tmp_path / "docs")
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 2), 2, "0"))
    got = exact_dedup.dedup(docs, digest=weak).collect()
    want, stay = brute(rows)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == stay


def test_state_outlives_arrivals_and_small_batches(spark, rows, tmp_path):
    """Three arrivals in one folder, each in several micro-batches, decide like one."""
    folder = str(tmp_path / "state")
    for k in range(3):
        docs = stored(spark, rows[k::3], tmp_path / f"docs{k}", parts=4)
        exact_dedup.absorb(docs, folder, batch_bytes=1)
        n = sum(len(rows[j::3]) for j in range(k + 1))
        assert exact_dedup.known(spark, folder).agg(F.sum("copies")).first()[0] == n
    docs = spark.read.parquet(*(str(tmp_path / f"docs{k}") for k in range(3)))
    checked(exact_dedup.decisions(docs, folder), rows)


def test_interrupted_between_arrival_and_state(spark, rows, tmp_path, monkeypatch):
    docs, folder = stored(spark, rows, tmp_path / "docs"), str(tmp_path / "state")
    with monkeypatch.context() as broken:
        broken.setattr(exact_dedup, "catch_up", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            exact_dedup.absorb(docs, folder)
    for _ in range(2):
        exact_dedup.catch_up(spark, folder)
    checked(exact_dedup.decisions(docs, folder), rows)


def test_large_group_is_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    monkeypatch.setattr(tables, "HOT_KEYS", 10)
    rows = [(i, "the same  text" if i % 3 else f"text {i % 7}", *[None] * 6) for i in range(400)]
    checked(exact_dedup.dedup(stored(spark, rows, tmp_path / "docs", parts=7)), rows)


def test_clashing_names_and_empty_table(spark, tmp_path):
    schema = "_metadata string, digest string, file long, key string, body string, content string"
    rows = [("m", "d", 1, "b", "x  y", "c"), ("m", None, 1, "a", "x y", "c"), (None, "d", None, None, None, "c")]
    got = exact_dedup.dedup(stored(spark, rows, tmp_path / "docs", schema), key="key", text="body")
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == [("a", "a", 2, True), ("b", "a", 2, False), (None, None, 1, True)]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty"))
    assert exact_dedup.dedup(spark.read.parquet(str(tmp_path / "empty")), key="key", text="body").count() == 0


def test_query_against_sql_and_native(spark):
    sf = "/root/testdata/sf0.001"
    got = exact_dedup.op11_exact_dedup(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracles.EXACT_DEDUP)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
