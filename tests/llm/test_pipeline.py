"""The pipeline over a small corpus, each stage against brute force, and the SQL of the corpus queries."""

import base64
import os
import random

import duckdb
import pytest

from tests.llm.data import prose, words
from tests.llm.test_operators import brute_components, brute_lines
from veridict.llm import line_dedup, tables

corpus_pipeline = pytest.importorskip("corpus_pipeline")

INSULTS = ["idiot", "pathetic", "worthless"]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean and toxic documents, copies, near copies, repeated lines, benchmark passages, nulls and empty texts."""
    rng, where = random.Random(20), tmp_path_factory.mktemp("corpus")
    items = [prose(rng, 30) for _ in range(4)]
    shared = prose(rng, 12)
    texts = []
    for i in range(240):
        text = f"{prose(rng, 40)}\n{prose(rng, 30)}"
        if i % 6 == 0:
            w = text.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
            text = " ".join(w)
        if i % 10 == 1:
            text = f"{shared}\n{text}"
        if i % 25 == 2:
            text = f"{text} {rng.choice(items)}"
        texts.append(text)
    for i in range(3, 240, 17):  # near copies: five words of a document in its place
        w = texts[i - 1].replace("\n", " ").split(" ")
        for _ in range(2):
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts[50], texts[51] = texts[7], texts[7]
    texts += [None, "", " \n\t", "one", "word " * 200, "x" * 3000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, int(any(w in words(texts[i]) for w in INSULTS))) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, items


def overlap(text, items):
    """Whether 13 aligned words agree in at least four of five with an item, by brute force."""
    own = words(text)
    for item in map(words, items):
        for start in range(-len(item) + 1, len(own)):
            low, high = max(0, start), min(len(own), start + len(item))
            agree = [own[k] == item[k - start] for k in range(low, high)]
            for a in range(len(agree)):
                for b in range(a + 13, len(agree) + 1):
                    if 5 * sum(agree[a:b]) >= 4 * (b - a):
                        return True
    return False


def test_stages_against_brute_force(spark, folder, tmp_path):
    where, rows, items = folder
    docs, before = spark.read.parquet(f"{where}/documents.parquet"), {r[0]: r for r in rows}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "byte-level BPE":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: tuple(r) for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "toxicity":
            clean = {i: r for i, r in before.items() if not any(w in words(r[1]) for w in INSULTS)}
            assert clean.items() <= after.items()
            assert len(after) - len(clean) <= 0.05 * (len(before) - len(clean))  # learnt from about thirty toxic documents
        elif name == "line dedup":
            want = brute_lines(list(before.values()))
            assert {i: r[1] for i, r in after.items()} == {i: t for i, (t, _) in want.items()}
            assert all(r[4] == (len(r[1]) if want[i][1] else before[i][4]) for i, r in after.items())
            assert all(r[2:4] == before[i][2:4] for i, r in after.items())
        elif name == "n-gram Jaccard join":
            assert after == {i: before[i] for i, (_, c) in brute_components(list(before.values()), 5, 80).items() if i == c}
            assert len(after) < len(before)
        else:
            assert after == {i: r for i, r in before.items() if not overlap(r[1], items)}
            assert len(after) < len(before)
        before = after
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(before)
    for i, r in got.items():
        assert r.ids == other.encode_ordinary(before[i][1] or "") and r.n_tokens == len(r.ids)


def test_run_is_the_stages_one_after_the_other(spark, folder):
    where, *_ = folder
    whole = {r.doc_id: (r.n_chars, r.n_tokens) for r in corpus_pipeline.run(spark, where).collect()}
    docs = spark.read.parquet(f"{where}/documents.parquet")
    from veridict.llm.tables import written

    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, where))
    assert {r.doc_id: (r.n_chars, r.n_tokens) for r in docs.collect()} == whole


def test_runs_delete_their_own_tables_only(spark, folder, tmp_path, monkeypatch):
    """A lazy result that someone holds outlives a run, and of a run only what its result reads is left."""
    where, rows, _ = folder
    held = line_dedup.op1_line_dedup(spark, where)
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    one, two = corpus_pipeline.run(spark, where), corpus_pipeline.run(spark, where)
    assert one.count() == two.count()
    left = set(os.listdir(tmp_path))
    assert left == {part for df in (one, two) for f in df.inputFiles() for part in f.split("/") if part in left} and len(left) == 2
    assert held.count() == len(rows)


def test_sql_of_corpus_queries(spark, folder):
    """The five queries that SQL can express, on the small corpus."""
    from veridict.llm import queries

    where, *_ = folder
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet/*.parquet')")
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, where), con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
        at = [want.columns.index(c) for c in columns]
        assert ours == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr), name


def test_tables_of_ids_are_never_broadcast(spark, monkeypatch):
    """However small a table of ids is on disk, the n-gram join shuffles it: its size as a broadcast has no bound."""
    from veridict.llm import ngram_join

    rng, plans, write = random.Random(3), [], tables.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(tables, "written", noted)
    monkeypatch.setattr(ngram_join, "written", noted)
    texts = [prose(rng, 60) for _ in range(20)]
    texts += [f"{t} changed" for t in texts[:8]] + [f"{t} changed again" for t in texts[:4]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = noted(ngram_join.keep_one(docs))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert len(plans) > 10 and not [p for p in plans if "BroadcastHashJoin" in p]
