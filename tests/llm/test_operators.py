"""Corpus operators against brute force on a small corpus with awkward rows."""

import base64
import collections
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import LOWER, SCHEMA, WORDS, corpus, prose, words
from veridict.llm import byte_bpe, chat, decontamination, line_dedup, lm_scoring, ngram_join, passages, quality, sharding, tables, toxicity


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- n-gram join


def brute_components(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * both:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_components(docs, rows, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs, size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_ngram_short_documents_and_shared_passages(spark, monkeypatch):
    """Links of short and long near copies among documents that share a passage; families don't grow by the passage."""
    rng = random.Random(19)
    passage = prose(rng, 40)
    rows = []
    for _ in range(60):
        w = prose(rng, rng.choice([3, 6, 9, 14, 25, 60, 120])).split() + (passage.split() if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 4])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, len(v) // 30 + 1])):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, percent in ((5, 80), (4, 85), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table, size, percent).collect()}
        assert got == brute_components(rows, size, percent), (size, percent)


def test_ngram_family_in_blocks(spark, monkeypatch):
    """A family of near copies larger than a row block."""
    rng = random.Random(1)
    base = prose(rng, 80).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "DENSE", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_ngram_keep_one_and_empty(docs, empty, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert ngram_join.components(empty).count() == 0


# --- line dedup


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_lines(a, b):
    """One word in lines of eight words or more, one character in lines of at most eight words and at least eight characters."""
    if a == b or len(a) >= 8 and len(b) >= 8 and within_one(a, b):
        return True
    x, y = " ".join(a), " ".join(b)
    return len(a) <= 8 and len(b) <= 8 and min(len(x), len(y)) >= 8 and abs(len(x) - len(y)) <= 1 and within_one(x, y)


def brute_lines(rows):
    earlier, out = [], {}
    for i, t, *_ in sorted(rows):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = words(line, lower=False)
            repeated = bool(w) and any(near_lines(w, e) for e in earlier)
            earlier += [w] if w else []
            gone += repeated
            kept += [] if repeated else [line]
        out[i] = (t if not gone else "\n".join(kept), gone)
    return out


def test_line_dedup(docs, rows, empty):
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in done.collect()} == brute_lines(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_edits_of_characters_and_words(spark):
    """Short lines one character apart, unspaced and long lines, eight words against seven; against brute force."""
    rng = random.Random(13)
    lines = [prose(rng, n) for n in (2, 3, 5, 7, 8, 8, 9, 12, 70, 140)] + ["中文没有空格的一行文字在这里", "short", "x" * 300]
    texts = list(lines)
    for _ in range(150):
        line = list(rng.choice(lines))
        if rng.random() < 0.5:
            line = "".join(line).split(" ")
            k = rng.randrange(len(line))
            line[k : k + 1] = rng.choice([[], ["new"], [line[k], "more"]])
            texts.append(" ".join(line))
        else:
            k = rng.randrange(len(line))
            line[k : k + 1] = rng.choice(["", "q", line[k] + "z", " "])
            texts.append("".join(line))
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[i * 4 : i * 4 + 4])) for i in range(40)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_frequent_lines(spark, monkeypatch):
    """A line, a half and a variant that most rows share, met without the shuffle and by a salt."""
    from veridict.llm import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    base = prose(random.Random(14), 11)
    rows = [(i, f"{base}\n{base} {i}\n{i} {base}\nother words {i} {i}{i}") for i in range(60)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_shared_ids_and_names(spark):
    """Rows that share an id are cut each for itself; equal rows alike; clashing columns; ids of any size."""
    a, b = "one two three four\nalpha beta", "five six seven\nalpha beta"
    rows = [(1, a, "k"), (1, b, "l"), (1, b, "m"), (2, "alpha beta\nnew", "n"), (-(1 << 62), "zeta", "o"), ((1 << 62), "zeta\nlast", "p")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_removed string").withColumn("_doc", F.lit("clash"))
    got = line_dedup.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "_doc", "n_removed"]
    texts = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert texts[2, "new"] == 1 and texts[1 << 62, "last"] == 1 and texts[-(1 << 62), "zeta"] == 1
    first = [(1, a), (1, "five six seven"), (1, "five six seven")], [(1, "one two three four"), (1, b), (1, b)]
    assert sorted(k for k in texts.elements() if k[0] == 1) in [sorted(f) for f in first]


def test_line_dedup_null_ids_stay(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (2, "a b c\nd")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == [(False, 1, "a b c"), (False, 2, "d"), (True, 0, "a b c"), (True, 0, "a b c")]


# --- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, tokenizer, empty):
    path, pattern, other = tokenizer
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, path, pattern).collect()}
    encoded = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern).collect()}
    for i, t, *_ in rows:
        ids = other.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and encoded[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(encoded[i].decoded) == (t or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode(empty, path, pattern).count() == 0


def test_bpe_long_pretokens(tokenizer):
    path, pattern, other = tokenizer
    bpe = byte_bpe.model(path, pattern)
    rng = random.Random(2)
    for n in (1, 2, 50, 4000):
        text = "".join(rng.choice("abcdeé中") for _ in range(n))
        assert bpe.encode(text)[0].tolist() == other.encode_ordinary(text)
    assert not any(bpe.low)


# --- passages


def test_passages(docs, rows, empty):
    found = {(r.doc_id, r.first_doc): (r.first_word, r.n_words) for r in passages.repeated_passages(docs).collect()}
    pairs = {(a, b) for a, b in found}
    assert {(5, 3), (6, 3), (21, 20), (22, 20)} <= pairs
    texts = {i: words(t) for i, t, *_ in rows}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    for (a, b), (first, n) in found.items():
        assert n >= 50
        own = texts[a][first : first + n]
        own = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        assert len(own & grams[b]) >= 0.8 * len(own)
    assert {a for a, _ in pairs} <= {5, 6, 8, 9, 10, 21, 22}
    assert passages.repeated_passages(empty).count() == 0


def tokens_of(*texts):
    import numpy as np

    number = collections.defaultdict(itertools.count().__next__)
    return [np.array([number[tuple(w[k : k + 5])] for k in range(len(w) - 4)], dtype=np.uint32) for w in texts]


def test_common_stretches_in_parts():
    """An exact passage inside a loosely edited copy, and a passage with words inserted in its middle."""
    w = [f"w{i}" for i in range(160)]
    loose = [f"e{i}" if i >= 60 and i % 8 == 4 else t for i, t in enumerate(w)]
    x, y = tokens_of(loose, w)
    found = passages.common_stretches(x, y, 46, 0.8)
    assert any(first == 0 and last >= 55 for first, last in found)
    x, y = tokens_of(w[:45] + ["new"] * 7 + w[45:90], w[:90])
    assert passages.common_stretches(x, y, 46, 0.8) == [(0, 92)]


def test_common_stretches_against_brute_force():
    """Every exact run of 46 tokens, also where tokens stand earlier in the other text; no stretch under the similarity."""
    rng = random.Random(11)
    for trial in range(25):
        base = [f"w{i}" for i in range(400)]
        other = base[100:130] + ["q"] + base[90:140] + ["r"] + base if trial % 2 else base
        own = [f"e{i}" if rng.random() < 0.03 else t for i, t in enumerate(base)]
        x, y = tokens_of(own, other)
        found = passages.common_stretches(x, y, 46, 0.8)
        runs = {tuple(y[k : k + 46]) for k in range(len(y) - 45)}
        for k in range(len(x) - 45):
            if tuple(x[k : k + 46]) in runs:
                assert any(first <= k and k + 45 <= last for first, last in found), (trial, k)
        for first, last in found:
            part = set(x[first : last + 1].tolist())
            assert last - first >= 45 and len(part & set(y.tolist())) >= 0.8 * len(part)


def test_passages_behind_an_earlier_fragment(spark):
    """Every repeated run of 50 words is found although earlier documents hold fragments or edited variants of it."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for trial in range(24):
        p = [word() for _ in range(55 + trial % 3)]
        cut = p[:49] if trial % 3 == 0 else p[5:45] if trial % 3 == 1 else [t if k not in (18, 40) else "edited" for k, t in enumerate(p)]
        variants = [cut, p, p, p[2:]] if trial % 4 else [cut + [word() for _ in range(70)] + p, p, cut, p]
        rows += [(10 * trial + k, " ".join([word() for _ in range(30)] + v + [word() for _ in range(30)])) for k, v in enumerate(variants)]
    got = collections.defaultdict(list)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert r.first_doc < r.doc_id
        got[r.doc_id].append((r.first_word, r.first_word + r.n_words))
    seen = {}
    for i, text in rows:
        w = text.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, run in enumerate(runs):
            if seen.setdefault(run, i) < i:
                assert any(first <= k and k + 50 <= end for first, end in got[i]), (i, k)


def test_passages_of_frequent_min_hashes(spark, monkeypatch):
    """A passage in most documents, its min-hashes dealt over several tasks, is met with the earliest document."""
    from veridict.llm import tables

    rng = random.Random(18)
    p = prose(rng, 70)
    rows = [(i, f"{prose(rng, 30)} {p} {prose(rng, 20)}" if i % 4 else prose(rng, 90)) for i in range(1, 90)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    usual = sorted(map(tuple, passages.repeated_passages(table).collect()))
    monkeypatch.setattr(tables, "HOT_ROWS", 8)
    monkeypatch.setattr(passages, "LOOKED_AT", 1)
    assert sorted(map(tuple, passages.repeated_passages(table).collect())) == usual
    assert {(a, b) for a, b, *_ in usual} >= {(i, 1) for i in range(2, 90) if i % 4}


def test_compact_windows():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, width in ((40, 7), (7, 7), (6, 7), (100, 1)):
        values = rng.permutation(n).astype(np.uint64) << np.uint64(30)
        first, centre, last = passages.compact_windows(values, width)
        seen = {}
        for a in range(n - width + 1):
            c = a + int(np.argmin(values[a : a + width]))
            lo, hi = seen.get(c, (a, a))
            seen[c] = (min(lo, a), max(hi, a))
        assert {(f, c, e) for f, c, e in zip(first, centre, last)} == {(a, c, b + width - 1) for c, (a, b) in seen.items()}


# --- sharding


def test_sharding(docs, rows, empty):
    got = sharding.interleave(docs, 7).collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for part in per.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    for source, n in collections.Counter(r.source for r in got).items():
        own = collections.Counter(r.shard for r in got if r.source == source)
        assert all(abs(own[s] - n / 7) <= 1.5 for s in range(7)), source
    assert sharding.interleave(empty, 3).count() == 0


def test_sharding_shared_and_null_keys(spark, docs, monkeypatch):
    """Rows that share a key or have none lie in one place only, whatever the partitions; equal rows are interchangeable."""
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", 4)
    rows = [(None if i % 3 == 0 else 1, f"s{i % 2}", f"t{i // 2}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, source string, shard string").withColumnRenamed("shard", "body")
    places = [sorted(((r.doc_id or 0, r.source, r.body), r.shard, r.slot) for r in sharding.interleave(t, 7).collect()) for t in (table, table.repartition(5, "body"))]
    assert places[0] == places[1] and len({p[1:] for p in places[0]}) == 60


def test_sharding_ties(spark):
    """Rows of one key whose columns are null in turn, or differ in arrays and maps only, have fixed places in any partitioning."""
    rows = [(7, None, "a", [k % 3], {"m": k // 3}, "s") for k in range(12)] + [(7, "a", None, [0], {}, None), (7, None, "a", [0], {}, None)]
    table = spark.createDataFrame(rows, "doc_id long, one string, other string, list array<int>, map map<string,int>, source string")
    places = []
    for parts in (1, 5, 3):
        got = sharding.interleave(table.repartition(parts).orderBy(F.rand(parts)), 4).collect()
        places.append({(r.one, r.other, tuple(r.list), tuple(r.map.items()), r.source): (r.shard, r.slot) for r in got})
    assert len(places[0]) == len(rows) and places[0] == places[1] == places[2]


def test_sharding_more_shards_than_rows(spark):
    rows = [(i, "s") for i in range(3)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), 24).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)


# --- chat


def brute_cost(roles):
    costs = {None: 0}
    for role in roles:
        role, after = chat.canonical_role(role), {}
        for last, c in costs.items():
            for to in chat.ROLES:
                extra = 0 if to == role else chat.RELABEL
                if to in chat.FOLLOWS[last]:
                    options = [0]
                elif to == last:
                    options = [chat.MERGE]
                else:
                    options = []
                options += [chat.INSERT for x in chat.FOLLOWS[last] if to in chat.FOLLOWS[x] and to not in chat.FOLLOWS[last]]
                for o in options:
                    after[to] = min(after.get(to, 10**9), c + extra + o)
        costs = after
    ends = {"assistant": 0, "user": 1, "system": 2, None: 0}
    return min(c + chat.INSERT * ends[s] for s, c in costs.items())


def test_chat_repair(spark):
    rng = random.Random(4)
    choices = ["user", "assistant", "system", "Human ", None, "narrator"]
    conversations = [[rng.choice(choices) for _ in range(rng.randint(1, 7))] for _ in range(60)] + [["user", "assistant"] * 300]
    rows = [(k, j, r, None if j == 2 else f"t<|{j}", "extra") for k, c in enumerate(conversations) for j, r in enumerate(c)]
    got = collections.defaultdict(list)
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")).collect():
        got[r.conv_id].append(r)
    for k, roles in enumerate(conversations):
        own = sorted(got[k], key=lambda r: r.turn)
        assert len(own) == len(roles)
        assert sum(r.cost for r in own) == brute_cost(roles), roles
        text = "".join(r.piece for r in own)
        heads = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
        last = None
        for h in heads:
            assert h in chat.FOLLOWS[last], (roles, heads)
            last = h
        assert last == "assistant" and text.count("<|im_end|>") == len(heads) and text.endswith(chat.CLOSE)


def test_chat_empty_and_null_ids(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0
    got = chat.repair(spark.createDataFrame([(None, None, "user", "a"), (None, 1, "assistant", "b")], schema)).collect()
    assert [r.role for r in sorted(got, key=lambda r: r.position)] == ["user", "assistant"]


# --- LM scoring


def test_lm_scoring(spark, docs, rows, empty):
    import math

    target = spark.createDataFrame([(i,) for i in range(0, 30)] + [(3,), (None,), (999,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.scores(docs, target, order=3, block_bytes=5000).collect()}

    def grams(t):
        b = bytes([0, 0]) + (t or "").encode()
        return [b[k : k + 3] for k in range(len(b) - 2)]

    size = {True: 0, False: 0}
    for i, t, *_ in rows:
        size[False] += len(grams(t))
        size[True] += len(grams(t)) * (i < 30)
    for i, t, *_ in rows:
        means = []
        for of_target, scale in ((True, 1.0), (False, size[True] / size[False])):
            n = collections.Counter(g for j, u, *_ in rows if j != i and (j < 30 or not of_target) for g in grams(u))
            h, low = collections.Counter(), collections.Counter()
            for g, c in n.items():
                h[g[:2]] += c
                low[g[2]] += c
            lower = lambda b: (scale * low[b] + 1 / 256) / (scale * sum(low.values()) + 1)  # noqa: E731, B023
            losses = [-math.log((scale * n[g] + lower(g[2])) / (scale * h[g[:2]] + 1)) for g in grams(t)]  # noqa: B023
            means.append(sum(losses) / len(losses) if losses else 0.0)
        assert got[i].n_tokens == len((t or "").encode())
        assert got[i].target_loss == pytest.approx(means[0]) and got[i].background_loss == pytest.approx(means[1])
        assert got[i].score == pytest.approx(means[0] - means[1])
    assert lm_scoring.scores(empty, target).count() == 0


def test_lm_scoring_members_score_like_others_of_their_kind(spark):
    """Half of the good documents are the target; the other half scores alike, the bad ones apart."""
    rng = random.Random(16)
    stems = ["ka", "lo", "mi", "tu", "pe", "zor"]
    other = lambda n: " ".join("".join(rng.choice(stems) for _ in range(3)) for _ in range(n))
    rows = [(i, prose(rng, 80) if i < 120 else other(80)) for i in range(160)]
    target = spark.createDataFrame([(i,) for i in range(0, 120, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in lm_scoring.scores(spark.createDataFrame(rows, "doc_id long, text string"), target, block_bytes=8000).collect()}
    mean = lambda ids: sum(got[i] for i in ids) / len(ids)
    members, fellows, bad = mean(range(0, 120, 2)), mean(range(1, 120, 2)), mean(range(120, 160))
    assert abs(members - fellows) < 0.02 and bad > max(members, fellows) + 0.2
    assert max(got[i] for i in range(120)) < min(got[i] for i in range(120, 160))


def test_lm_scoring_shared_and_null_ids(spark, monkeypatch):
    from veridict.llm import tables

    rng = random.Random(17)
    rows = [(None if i % 5 == 0 else 7 if i % 5 == 1 else i, prose(rng, 20)) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash"))
    target = spark.createDataFrame([(7,), (2,), (None,)], "doc_id long")
    one = sorted(map(tuple, lm_scoring.scores(table, target).collect()), key=repr)
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    many = sorted(map(tuple, lm_scoring.scores(table, target, block_bytes=900).collect()), key=repr)
    assert len(one) == len(many) == 60
    for x, y in zip(one, many, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])


# --- quality rules


def test_quality_counts(docs, rows, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {x for x, c in collections.Counter(windows).items() if c > 1}
        covered = {p for k, x in enumerate(windows) if x in twice for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[i]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)), i
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(30))
    assert quality.judge(empty).count() == 0


def test_quality_em_learns_rules(spark):
    """Votes drawn from known accuracies give them back."""
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.7
        row = []
        for k in range(len(quality.VOTES)):
            right = rng.random() < (0.95 if k % 2 else 0.7)
            row.append(None if rng.random() < 0.2 else int(good if right else not good))
        rows.append(tuple(row))
    votes = spark.createDataFrame(rows, ", ".join(f"{v} int" for v in quality.VOTES))
    model = quality.fit(votes)
    assert model["good"] == pytest.approx(0.7, abs=0.04)
    for k, v in enumerate(quality.VOTES):
        for side in ("good", "bad"):
            assert model[f"{v}_{side}"] == pytest.approx(0.95 if k % 2 else 0.7, abs=0.06)


def test_quality_em_learns_kinds_of_bad_documents(spark):
    """The shipped belief: bad documents of three kinds, each found by two or three rules; accuracies move from the belief to what was planted."""
    rng = random.Random(15)
    kinds = ((2, 6), (2, 9), (4, 5, 7, 8))
    planted, rows, truth = collections.Counter(), [], []
    for _ in range(3000):
        bad = rng.random() < 0.15
        kind = rng.choice(kinds) if bad else ()
        row = [int(not (rng.random() < 0.95 if k in kind else rng.random() < 0.001)) for k in range(len(quality.VOTES))]
        planted.update((k, bad) for k, v in enumerate(row) if (v == 0) == bad)
        rows.append(tuple(None if v and rng.random() < 0.1 else v for v in row))
        truth.append(bad)
    model = quality.fit(spark.createDataFrame(rows, ", ".join(f"{v} int" for v in quality.VOTES)))
    n_bad = sum(truth)
    assert model["good"] == pytest.approx(1 - n_bad / 3000, abs=0.02)
    for k, v in enumerate(quality.VOTES):
        assert model[f"{v}_bad"] == pytest.approx(planted[k, True] / n_bad, abs=0.1), v
        assert model[f"{v}_good"] == pytest.approx(planted[k, False] / (3000 - n_bad), abs=0.02), v


def test_quality_awkward_rows(spark, docs):
    """Repeated rows and clashing columns."""
    table = docs.withColumns({"quality": F.lit("clash"), "_plain": F.lit(1), "n_words": F.lit(2)})
    got = quality.judge(table.unionByName(table))
    assert got.count() == 2 * docs.count() and dict(got.dtypes)["n_words"] == "bigint"
    assert got.groupBy("doc_id").agg(F.countDistinct("kept").alias("n")).where("n > 1").isEmpty()


# --- toxicity


@pytest.fixture(scope="module")
def machine(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        text, bad = prose(rng, 40).split(), i % 4 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "pathetic", "worthless"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (7, None), (5000, 1)]
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_held_out(spark, machine):
    rng = random.Random(7)
    clean = [prose(rng, 60) for _ in range(50)]
    forms = ["idiot", "IDIOT!", "i d i o t", "i-d-i-o-t", "idiiot", "1diot", "pathetic.", "pathxetic", "p a t h e t i c", "worthless"]
    bad = [f"{prose(rng, 30)} {f} {prose(rng, 10)}" for f in forms]
    rows = list(enumerate([*clean, *bad, None, "", "?!"]))
    got = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    assert max(got[i] for i in range(50)) < 0.3
    assert {f: got[50 + k] >= 0.3 for k, f in enumerate(forms)} == dict.fromkeys(forms, True)
    assert all(got[60 + k] < 0.3 for k in range(3))


def test_toxicity_ignores_chunking(machine):
    rng = random.Random(8)
    texts = [prose(rng, 20) for _ in range(30)] + [None, "", "x"]
    together = machine.margins(pa.array(texts))
    assert together.tolist() == [machine.margins(pa.array([t]))[0] for t in texts] == [machine.margins(pa.array([t], pa.large_string()))[0] for t in texts]


def test_toxicity_kernel_against_direct_computation():
    """The table of subsequence weights and Features.kernel agree with sums over all pairs of subsequences."""
    import numpy as np

    def subsequences(w):
        w, out = f"^{w}^", collections.Counter()
        for i in range(len(w)):
            for second, third in toxicity.PATTERNS:
                if i + third < len(w):
                    out[w[i], w[i + second], w[i + third]] += toxicity.DECAY ** (third - 2)
        length = sum(sum(toxicity.DECAY ** (2 * (third - 2)) for _, third in toxicity.PATTERNS if i + third < len(w)) for i in range(len(w)))
        return {k: v / length**0.5 for k, v in out.items()}

    rng = random.Random(12)
    texts = [prose(rng, 1) for _ in range(20)] + ["idiot", "idxiot", "aaaaaa", "ab"]
    s = toxicity.spell_words(texts)
    begin = np.cumsum(s.size) - s.size
    symbols = [s.symbols[a + 1 : a + n - 1].astype(np.uint8).tobytes() for a, n in zip(begin, s.size, strict=True)]
    features = toxicity.Features(symbols)
    got = features.kernel(features)
    vectors = [subsequences(t) for t in texts]
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            assert got[i, j] == pytest.approx(sum(v * y.get(k, 0) for k, v in x.items()), rel=1e-5, abs=1e-6), (texts[i], texts[j])
    assert got[20, 21] > 0.5 > got[20, 0]


def test_toxicity_awkward_rows(spark, docs, machine):
    """Repeated rows, a clashing column and very long words; equal texts score alike."""
    table = docs.withColumn("toxicity", F.lit("clash")).unionByName(docs.withColumn("toxicity", F.lit("other")))
    got = toxicity.score(table, machine)
    assert got.columns == [*docs.columns, "toxicity"] and got.count() == 2 * docs.count()
    assert got.groupBy("text").agg(F.countDistinct("toxicity").alias("n")).where("n > 1").isEmpty()


def test_toxicity_without_examples(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).select("toxicity").distinct().count() == 1


def test_held_out_rule(spark):
    got = spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# --- decontamination


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    rng = random.Random(9)
    items = [prose(rng, 40), prose(rng, 12), prose(rng, 6), "too short", None, "", prose(rng, 30)]
    swapped = items[0].split()
    swapped[6], swapped[19] = "zzz", "yyy"
    texts = [
        f"{prose(rng, 30)} {items[0].upper()} {prose(rng, 5)}", f"{prose(rng, 9)}\n{' '.join(swapped)}", items[1], f"x {items[2]} y",
        " ".join(items[6].split()[5:18]), " ".join(items[6].split()[5:16]), "too short", prose(rng, 50),
    ]
    table = spark.createDataFrame([(1000 + k, t, "en", "s", 1, "c", "i", 1) for k, t in enumerate(texts)], SCHEMA).unionByName(docs)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bits, texts_out in ((decontamination.MOST_BITS, 10**6), (3, 0)):  # a bitmap that lets nearly all pass, texts taken out by a shuffle
        monkeypatch.setattr(decontamination, "MOST_BITS", bits)
        monkeypatch.setattr(decontamination, "BROADCAST_TEXTS", texts_out)
        found = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_agree) for r in decontamination.overlaps(table, bench).collect()}
        assert found == {
            (1000, 0): (30, 40, 40), (1001, 0): (9, 40, 38), (1002, 1): (0, 12, 12), (1003, 2): (1, 6, 6), (1004, 6): (0, 13, 13),
        }
        kept = decontamination.decontaminate(table, bench)
        assert kept.columns == table.columns
        assert {r.doc_id for r in kept.collect()} == {*range(len(rows)), 1005, 1006, 1007}
    assert decontamination.overlaps(empty, bench).count() == 0
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_repeated_items_and_rows(spark, docs):
    """Items that come twice, and documents that come twice, are reported each; clashing columns are ignored."""
    rng = random.Random(21)
    item = prose(rng, 20)
    table = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (None, f"a {item}", "z"), (2, None, "w")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, item), (6, item.upper()), (None, item), (7, prose(rng, 20))], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.first_word) for r in decontamination.overlaps(table, bench).collect())
    assert got == {(1, 5, 0): 2, (1, 6, 0): 2, (1, None, 0): 2, (None, 5, 1): 1, (None, 6, 1): 1, (None, None, 1): 1}
    assert decontamination.decontaminate(table, bench).count() == 1


def test_masks_are_lossless():
    for gone in itertools.combinations(range(13), 2):
        assert any(not {o + j for j in m} & {*gone} for m in decontamination.MASKS for o in range(13 - m[-1]))


@pytest.mark.parametrize("n,k", [(n, n // 5) for n in range(9, 26)])
def test_no_replacement_hides_an_overlap(n, k):
    """Every placing of as many replaced words as 4 of 5 allows; a longer stretch holds one of these with no larger share."""
    masks = [sum(1 << j for j in m) for m in decontamination.MASKS + (() if n >= decontamination.MIN_WORDS else (decontamination.SHORT_MASK,))]
    seen = [m << o for m in masks for o in range(n) if m << o < 1 << n]
    for gone in itertools.combinations(range(n), k):
        lost = sum(1 << j for j in gone)
        assert any(not m & lost for m in seen), gone


def test_overlaps_with_any_fifth_replaced(spark):
    item, texts, wanted = [f"w{j}" for j in range(25)], [], set()
    for n, k in ((9, 1), (10, 2), (11, 2), (12, 2), (13, 2), (15, 3)):
        for g in itertools.combinations(range(n), k):
            wanted.add((len(texts), n))
            texts.append(" ".join(f"x{j}" if j in g else f"{n}{w}" for j, w in enumerate(item[:n])))
    bench = spark.createDataFrame([(n, " ".join(f"{n}{w}" for w in item[:n])) for n in (9, 10, 11, 12, 13, 15)], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.overlaps(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)


def test_overlaps_against_brute_force(spark, monkeypatch):
    """All columns, with frequent seeds, items and texts dealt over tasks."""
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    rng = random.Random(33)
    common = prose(rng, 14)
    items = [f"{prose(rng, rng.choice([0, 3, 20]))} {common if k % 2 else ''} {prose(rng, rng.choice([5, 12, 40]))}".split() for k in range(12)]
    items[3][4:8] = items[5][2:6]
    texts = []
    for k in range(60):
        w = list(rng.choice(items))[rng.randrange(4) :]
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        if k % 5 == 0:
            at = rng.randrange(len(w))
            w[at : at + 4] = ["other"] * len(w[at : at + 4])
        texts.append(f"{prose(rng, rng.randrange(6))} {' '.join(w)} {prose(rng, rng.randrange(6))}" if k % 7 else f"{prose(rng, 5)} {common}")
    texts += [texts[0]] * 9
    wanted = {}
    for d, text in enumerate(texts):
        own = words(text)
        for i, item in enumerate(items):
            best = brute_overlap(own, item)
            if best:
                wanted[d, i] = best
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_agree) for r in decontamination.overlaps(table, bench).collect()}
    assert got == wanted and len({d for d, _ in wanted}) > 40


def brute_overlap(own, item):
    """First word, words, agreeing words of the best-scoring stretch of every way to lay the item on the text."""
    best, least = None, min(13, len(item))
    for start in range(1 - len(item), len(own)):
        low, high = max(0, start), min(len(own), start + len(item))
        same = [own[j] == item[j - start] for j in range(low, high)]
        if 5 * sum(same) < 4 * least:
            continue
        sums, found = [0, *itertools.accumulate(same)], []
        for a, b in itertools.combinations(range(len(sums)), 2):
            n, k = b - a, sums[b] - sums[a]
            found.append((5 * k - 4 * n, n, a, k))
        top = max(f[0] for f in found)
        score, n, a, k = min((f for f in found if f[0] == top), key=lambda f: (f[2] + f[1], f[2]))
        if n < least or score <= 0:
            wide = [f for f in found if f[0] >= 0 and f[1] >= least]
            if not wide:
                continue
            score, n, a, k = max(wide, key=lambda f: (f[1], -f[2]))
        if len(item) < 9 and (n < len(item) or k < n):
            continue
        if best is None or (-k, low + a) < (-best[2], best[0]):
            best = (low + a, n, k)
    return best


def test_word_hashes_tell_words_apart():
    from veridict.llm.words import words as hashed

    texts = ["a b", "ab", "A  B", None, "a\tb\n", "\x0b", "é e"]
    (w,) = hashed(pa.array(texts))
    per = [w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist() for i in range(len(texts))]
    assert per[0] == per[2] == per[4] and per[1] != per[0] and per[3] == per[5] == [] and len(set(per[6])) == 2
    assert LOWER[65] == "a"


def test_components_of_paths_and_hubs(spark):
    from veridict.llm.tables import connected_components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (161, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {160: 160, 161: 160}
    assert got == want
    assert F is not None


def test_near_passages_behind_fragments(spark):
    """Near copies (one word of sixty changed) are found though earlier documents hold fragments of the passage."""
    rng, sizes = random.Random(100), (0, 20, 30, 40, 49)
    rows, pairs = [], {size: set() for size in sizes}
    for size in sizes:
        for k in range(40):
            p, at, own = prose(rng, 60).split(), rng.randrange(61 - size), 100 * size + k
            changed = [*p[:30], "changed", *p[31:]]
            rows.append((own, f"{prose(rng, 40)} {' '.join(p[at : at + size])} {prose(rng, 40)}"))
            rows.append((10_000 + own, f"{prose(rng, 50)} {' '.join(p)} {prose(rng, 50)}"))
            rows.append((20_000 + own, f"{prose(rng, 30)} {' '.join(changed)} {prose(rng, 70)}"))
            pairs[size].add((20_000 + own, 10_000 + own))
    found = {(r.doc_id, r.first_doc) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(len(found & pairs[size]) >= 36 for size in sizes)
    # nearly all of 49 words and one that happens to agree are a near repeat of the fragment itself
    assert all(a % 10_000 == b % 10_000 for a, b in found)


def test_meetings_across_batches():
    """Heads and documents before, whatever the batches are."""
    rng = random.Random(9)
    rows = sorted((rng.randrange(6), rng.randrange(2), rng.randrange(5), rng.randrange(50)) for _ in range(300))
    names = ["key", "salt", "doc_id", "centre", "first", "last", "h", "parts"]

    class Windows:
        def __init__(self, size):
            self.size = size

        def mapInArrow(self, run, schema):  # noqa: N802
            table = pa.table([*(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2, 3, 3, 3)), pa.array([1] * len(rows), pa.int8()), pa.array([None] * len(rows), pa.int64())], names=names)
            return [x for b in run(iter(table.to_batches(max_chunksize=self.size))) for x in b.to_pylist()]

    want = []
    for k, (key, salt, doc, centre) in enumerate(rows):
        head = next(r for r in rows if r[:2] == (key, salt))
        earlier = [r for r in rows[:k] if r[:2] == (key, salt) and r[2] != doc]
        if head[2] != doc:
            want.append((doc, centre, head[2], head[3], earlier[-1][2], earlier[-1][3]))
    for size in (1, 2, 7, 300):
        got = [(r["doc_id"], r["centre"], r["first_doc"], r["centre0"], r["before_doc"], r["centre1"]) for r in passages._meet(Windows(size))]
        assert got == want


def test_near_passages_between_fragments(spark, monkeypatch):
    """Near copies are found though the earliest document and the one just before both hold fragments only."""
    rng, sizes = random.Random(101), (20, 30, 40, 49)
    rows, pairs = [], {size: set() for size in sizes}
    for size in sizes:
        for k in range(20):
            p, own = prose(rng, 60).split(), 100 * size + k
            ats = [min(60 - size, 31) if k % 2 else 0] * 2  # the fragment in both
            changed = [*p[:30], "changed", *p[31:]]
            fragment = lambda at: f"{prose(rng, 40)} {' '.join(p[at : at + size])} {prose(rng, 40)}"  # noqa: B023, E731
            rows.append((own, fragment(ats[0])))
            rows.append((10_000 + own, f"{prose(rng, 50)} {' '.join(p)} {prose(rng, 50)}"))
            rows += [(20_000 + own + 1000 * i, fragment(ats[1])) for i in range(1, 4)]
            rows.append((30_000 + own, f"{prose(rng, 30)} {' '.join(changed)} {prose(rng, 70)}"))
            pairs[size].add((30_000 + own, 10_000 + own))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every = None
    for few in (passages.FEW, 1):  # the groups as a whole, and by what they have in common
        monkeypatch.setattr(passages, "FEW", few)
        got = {(r.doc_id, r.first_doc) for r in passages.repeated_passages(table).collect()}
        print(few, [len(got & pairs[size]) for size in sizes])
        every = got & set().union(*pairs.values()) if every is None else every
        assert all(len(got & pairs[size]) >= 18 for size in sizes)
        assert every <= got


def test_passages_leave_one_table(spark):
    """What is written on the way is deleted, so disk does not add up over the steps; only the result stays."""
    rng = random.Random(102)
    p = prose(rng, 80).split()
    rows = [(1, " ".join(p)), (2, " ".join([*p[:60], *prose(rng, 10).split()])), (3, prose(rng, 90))]
    folder = tables.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({f for f in os.listdir(folder) if not f.startswith(".")} - before) == 1
    assert [tuple(r) for r in found.collect()] == [(2, 1, 0, 60)]


def test_pairs_without_a_similar_stretch_are_told_beforehand():
    """The quick test of a batch lets every pair with a similar stretch pass, and few others."""
    rng, passed, found = np.random.default_rng(5), 0, 0
    for _ in range(400):
        x = rng.integers(0, rng.choice([8, 60, 10**6]), int(rng.integers(20, 160))).astype(np.uint32)
        y = x.copy()
        for _ in range(int(rng.integers(0, 10))):
            k = int(rng.integers(0, len(y)))
            y = np.concatenate([y[:k], rng.integers(0, 10**6, int(rng.integers(0, 6))).astype(np.uint32), y[k + int(rng.integers(0, 6)) :]])
        may = bool(passages._possible(pa.array([b"", x.tobytes()], pa.binary()), pa.array([b"", y.tobytes()], pa.binary()), 0.8 * 46)[1])
        got = passages.common_stretches(x, y, 46, 0.8)
        assert may or not got
        passed, found = passed + may, found + bool(got)
    assert found > 100 and passed < 400


def test_pairs_that_share_too_little_in_one_place_are_told_beforehand():
    """Of a batch, every pair with a similar stretch passes the second quick test, too; shared tokens far apart do not."""
    rng, xs, ys = np.random.default_rng(6), [], []
    for _ in range(400):
        x = rng.integers(0, rng.choice([8, 60, 10**6]), int(rng.integers(0, 160))).astype(np.uint32)
        y = x.copy()
        for _ in range(int(rng.integers(0, 14))):
            k = int(rng.integers(0, len(y) + 1))
            y = np.concatenate([y[:k], rng.integers(0, 10**6, int(rng.integers(0, 6))).astype(np.uint32), y[k + int(rng.integers(0, 6)) :]])
        xs.append(x)
        ys.append(y)
    xs.append(np.arange(160, dtype=np.uint32))  # 60 of 160 tokens, never 37 of 46
    ys.append(np.concatenate([xs[-1][:30], xs[-1][130:]]))
    column = lambda arrays: pa.array([a.tobytes() for a in arrays], pa.binary())
    may = passages._reaching(column(xs), column(ys), 46, 0.8)
    first = passages._possible(column(xs), column(ys), 0.8 * 46)
    got = np.array([bool(f and passages.common_stretches(x, y, 46, 0.8)) for f, x, y in zip(first, xs, ys, strict=True)])
    assert may[got].all() and got.sum() > 100 and first[-1] and not may[-1]
    assert not passages._reaching(column(xs[:0]), column(ys[:0]), 46, 0.8).size


def test_pairs_of_places_are_one_row(spark):
    """A pair of places is one row for both windows and makes the same candidates as one row a window; on two diagonals it is two."""
    rng, pairs, edges = random.Random(103), [], []
    window = lambda at: (at, at + rng.randrange(46), at + 45 + rng.randrange(20))
    for k in range(400):
        doc, first, at, at0 = rng.randrange(4, 8), rng.randrange(4), 300 * rng.randrange(4), 300 * rng.randrange(4)
        met, met0 = [], []
        for h in sorted(rng.sample(range(4), 2)):
            a, c, b = window(at + rng.randrange(5))
            jump = rng.choice([0, 3, 200]) if k % 5 == 0 else 0
            met.append((h, a, c, b))
            met0.append((h, a + at0 - at + jump, c + at0 - at + jump, b + at0 - at + jump))
            edges.append((doc, first, h, c, met0[-1][2], a, b, met0[-1][1], met0[-1][3]))
        pairs.append((doc, first, (*met[0], *met[1]), (*met0[0], *met0[1])))
    struct = "struct<h: int, first: int, centre: int, last: int, h_: int, first_: int, centre_: int, last_: int>"
    both = passages._meetings(spark.createDataFrame(pairs, f"doc_id long, first_doc long, met {struct}, met0 {struct}"), 46)
    far = sum(abs((p[3][2] - p[2][2]) - (p[3][6] - p[2][6])) > 46 for p in pairs)
    assert far > 5 and both.count() == 400 + far
    each = spark.createDataFrame(edges, "doc_id long, first_doc long, h int, centre int, centre0 int, first int, last int, first0 int, last0 int")
    result = lambda cut: sorted(map(tuple, passages._candidates(cut, 46, 2).collect()))
    assert result(both) == result(passages._intervals(each)) != []


def test_pairs_of_a_large_group_are_dealt(spark, monkeypatch):
    """All pairs of a group are made once, by several tasks where they are many."""
    monkeypatch.setattr(passages, "PAIRS", 500)
    left = spark.createDataFrame([(k, d) for k, n in ((1, 100), (2, 3), (3, 5)) for d in range(n)], "k long, doc_id long")
    right = spark.createDataFrame([(k, d) for k, n in ((1, 90), (2, 2), (4, 5)) for d in range(n)], "k long, first_doc long")
    made = passages._dealt_pairs(tables.written(left), tables.written(right))
    assert sorted(map(tuple, made.collect())) == sorted((k, a, b) for k, n, m in ((1, 100, 90), (2, 3, 2)) for a in range(n) for b in range(m))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = passages._dealt_pairs(tables.written(left), tables.written(right))
        tasks = made.where("k = 1").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1
