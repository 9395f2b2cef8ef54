"""Toxicity by a subsequence string kernel and a Nystroem support vector machine.

Two words are compared by the subsequences of three letters that they share,
each weighted down for every letter it skips; a word's beginning and end count
as letters.  So an insult still resembles itself when letters are inserted or
left out.  Signs are dropped, digits read as the letters they imitate, and
runs of single letters ("i d i o t") read as one word.

The examples are the sentences of labelled documents, each with its document's
label; a sentence is as toxic as its worst word, its witness.  Not every
sentence of a toxic document is toxic, so training is multiple-instance: the
machine chooses the worst sentences of every toxic document as the examples of
its class, is trained against the worst and some random sentences of the other
documents, and chooses again.  The choice in a document is always made by a
machine that has not seen it (documents are dealt into folds); the first
choice is made by the log-odds of subsequences, a document's own taken out.
Landmark witnesses span the Nystroem feature space.

As the decision is linear in the landmarks' kernels, and a landmark's kernel
is linear in subsequence weights, the trained machine is one table of 64^3
weights, and a text is scored in time proportional to its length.  A
document's score is a logistic function of its three worst words' margins and
its length, fitted to margins of machines that have not seen the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veridict.llm.tables import written
from veridict.llm.words import chunks, spans, text_buffer

DECAY = 0.6
#: (second, third) letter's distance from the first, at most three letters skipped.
PATTERNS = tuple((i, i + j) for i in range(1, 5) for j in range(1, 5) if i + j <= 5)
#: Bound of the training sample: expected number of labelled documents of each class.
DOCUMENTS = 4000
#: Sentences that a toxic document offers in a round, and any other one: the worst, and some at random.
TOXIC_SENTENCES, WORST, RANDOM = 3, 2, 1
#: Landmarks of each class, folds and rounds of choosing sentences.
LANDMARKS, FOLDS, ROUNDS = 192, 4, 4
#: Words with more symbols than this are scored but are no examples.
LONGEST = 64
#: Words of single letters in a row that are read as one.
SPELT = 3
#: Worst words of a document that the score looks at.
POOLED = 3
_DROP = 255
_CHUNK = 1 << 20
_CODES = 1 << 18


def _symbols() -> np.ndarray:
    """Symbol of each byte: 1-26 letters, 27-58 bytes of other letters, 59 rare digits, 0 white space, _DROP signs."""
    table = np.full(256, _DROP, dtype=np.uint8)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    for k in range(26):
        table[[65 + k, 97 + k]] = 1 + k
    table[128:] = 27 + (np.arange(128) & 31)
    table[ord("0") : ord("9") + 1] = 59
    for digit, letter in zip("013457", "oieast", strict=True):
        table[ord(digit)] = table[ord(letter)]
    return table


_TABLE = _symbols()
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


@dataclass
class Spelling:
    """Words of consecutive texts as symbols, each between two zeros.

    ``size`` is each word's number of symbols with its zeros; the words of
    text ``i`` are ``bounds[i]:bounds[i + 1]``; ``sentence`` numbers the
    sentences, across texts.
    """

    symbols: np.ndarray
    size: np.ndarray
    bounds: np.ndarray
    sentence: np.ndarray


def spell(buf: np.ndarray, cuts: np.ndarray) -> Spelling:
    """Symbols of the texts that lie between ``cuts`` in a byte buffer."""
    coded = _TABLE[buf]
    kept = coded != _DROP
    # a sentence ends at a line's end, and at one of .!? before white space
    over = buf == 0x0A
    over[:-1] |= _ENDS[buf[:-1]] & (coded[1:] == 0)
    ended = np.cumsum(over, dtype=np.int32)[kept]
    place = np.concatenate([[0], np.cumsum(kept)])
    cuts, coded = place[cuts], coded[kept]
    # spans() tells words from white space by byte values: any byte above 0x20 stands for a letter
    starts, ends = spans(np.where(coded > 0, 0x41, 0x20).astype(np.uint8), cuts)
    length = ends - starts
    text = np.searchsorted(cuts, starts, "right")
    joins = np.zeros(len(starts), dtype=bool)  # the word goes on with the one before it
    if len(starts) > 1:
        joins[1:] = (length[1:] == 1) & (length[:-1] == 1) & (text[1:] == text[:-1])
        run = np.cumsum(~joins)
        joins &= np.bincount(run)[run] >= SPELT
    unit = np.cumsum(~joins) - 1
    units = int(unit[-1]) + 1 if len(unit) else 0
    letters = coded[coded > 0]
    owner = np.repeat(unit, length)
    out = np.zeros(len(letters) + 2 * units, dtype=np.int32)
    out[np.arange(len(letters)) + 2 * owner + 1] = letters
    size = np.bincount(unit, length, units).astype(np.int64) + 2 if units else np.zeros(0, np.int64)
    bounds = np.searchsorted(text[~joins], np.arange(1, len(cuts) + 1), "left")
    return Spelling(out, size, bounds, (ended[starts] + text)[~joins])


def spell_words(words: list[str]) -> Spelling:
    raw, cuts = text_buffer(pa.array(words, pa.string()))
    return spell(raw[cuts[0] : cuts[-1]], cuts - cuts[0])


def _norms(size: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector when no subsequence repeats; a function of its size alone."""
    total = np.zeros(len(size))
    for _, third in PATTERNS:
        total += DECAY ** (2 * (third - 2)) * np.maximum(size - third, 0)
    return np.sqrt(np.maximum(total, 1e-9))


def _codes(symbols: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(whether inside a word, subsequence code, weight) of all subsequences, a pattern at a time."""
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    for second, third in PATTERNS:
        n = len(symbols) - third
        if n <= 0:
            continue
        code = (symbols[:n] << 12) | (symbols[second : second + n] << 6) | symbols[third:]
        yield word[:n] == word[third:], code, DECAY ** (third - 2)


class Features:
    """Normalised subsequence features of words, row by row; words are given as symbols without the zeros."""

    def __init__(self, words: list[bytes]) -> None:
        size = np.array([len(w) + 2 for w in words], dtype=np.int64)
        symbols = np.frombuffer(b"".join(b"\0" + w + b"\0" for w in words), np.uint8).astype(np.int32)
        word = np.repeat(np.arange(len(size)), size)
        rows, codes, weights = [], [], []
        for inside, code, weight in _codes(symbols, size):
            rows.append(word[: len(code)][inside].astype(np.int32))
            codes.append(code[inside])
            weights.append(np.full(int(inside.sum()), weight, dtype=np.float32))
        rows = np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        self.codes = np.concatenate(codes)[order]
        self.weights = (np.concatenate(weights)[order] / _norms(size)[rows[order]]).astype(np.float32)
        self.starts = np.searchsorted(rows[order], np.arange(len(size) + 1))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def kernel(self, landmarks: "Features", map_: np.ndarray | None = None) -> np.ndarray:
        """Kernel of every word with each landmark, times ``map_`` if given; a thousand words at a time."""
        used, column = np.unique(landmarks.codes, return_inverse=True)
        across = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)  # the last row is for other codes
        np.add.at(across, (column, np.repeat(np.arange(len(landmarks)), np.diff(landmarks.starts))), landmarks.weights)
        if map_ is not None:
            across = across @ map_.astype(np.float32)
        out = np.zeros((len(self), across.shape[1]), dtype=np.float32)
        step = 1000
        for a in range(0, len(self), step):
            b = min(a + step, len(self))
            low, high = self.starts[a], self.starts[b]
            at = np.minimum(np.searchsorted(used, self.codes[low:high]), len(used) - 1)
            at[used[at] != self.codes[low:high]] = len(used)
            out[a:b] = np.add.reduceat(across[at] * self.weights[low:high, None], self.starts[a:b] - low)
        return out


@dataclass
class Machine:
    """Subsequence weights and bias of the support vector machine, and the logistic over a document's evidence."""

    weights: np.ndarray
    bias: float
    #: Weights of the three worst margins, of the length, and the constant.
    pooling: np.ndarray = field(default_factory=lambda: np.array([3.0, 0, 0, 0, 0]))

    def word_margins(self, s: Spelling) -> np.ndarray:
        total = np.zeros(len(s.symbols), dtype=np.float32)
        for inside, code, weight in _codes(s.symbols, s.size):
            total[: len(code)] += self.weights[code] * (inside * np.float32(weight))
        return np.add.reduceat(total, np.cumsum(s.size) - s.size) / _norms(s.size) + self.bias

    def evidence(self, column: pa.Array) -> np.ndarray:
        """For each text: margins of its three worst words (different ones), and the logarithm of its number of words.

        Texts with fewer words have the bias for those they lack.
        """
        raw, bounds = text_buffer(column)
        out = np.full((len(bounds) - 1, POOLED + 1), self.bias)
        out[:, POOLED] = 0
        for a, b in chunks(bounds, _CHUNK):
            s = spell(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            if not len(s.size):
                continue
            margin, text = self.word_margins(s), np.repeat(np.arange(b - a), np.diff(s.bounds))
            order = np.lexsort((-margin, text))
            text, margin = text[order], margin[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (margin[1:] != margin[:-1])])
            text, margin = text[new], margin[new]
            rank = np.arange(len(text)) - np.searchsorted(text, text, "left")
            few = rank < POOLED
            out[a + text[few], rank[few]] = margin[few]
            out[a:b, POOLED] = np.log1p(np.diff(s.bounds))
        return out

    def margins(self, column: pa.Array) -> np.ndarray:
        """Greatest margin of a word, and so of a sentence, in each text; the bias for texts without words."""
        return self.evidence(column)[:, 0]

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(evidence) @ self.pooling, -30, 30)))


def _design(evidence: np.ndarray) -> np.ndarray:
    # the worst margin as it is; a second and third bad word speak for toxicity, their lack not against it
    worst, others = np.clip(evidence[:, :1], -3, 3), np.clip(evidence[:, 1:POOLED], 0, 3)
    return np.column_stack([worst, others, evidence[:, POOLED] / 5, np.ones(len(evidence))])


def train_words(words: list[bytes], toxic: np.ndarray, weights: np.ndarray, penalty: float = 1.0, steps: int = 30) -> list[Machine]:
    """Squared-hinge machines on Nystroem features of witnesses, by Newton steps.

    ``weights`` has a row for each machine: how much it looks at each word.
    Landmarks are the words of each class with most weight, the same for all.
    """
    if not toxic.any() or toxic.all():
        return [Machine(np.zeros(_CODES, np.float32), 1.0 if toxic.any() else -1.0) for _ in weights]
    total = weights.sum(axis=0)
    most = lambda side: np.flatnonzero(side)[np.argsort(-total[side], kind="stable")[:LANDMARKS]]
    landmarks = Features([words[k] for k in np.concatenate([most(toxic), most(~toxic)])])
    value, vector = np.linalg.eigh(landmarks.kernel(landmarks).astype(np.float64))
    good = value > 1e-4 * value.max()
    half = vector[:, good] / np.sqrt(value[good])
    phi = np.empty((len(words), half.shape[1]), dtype=np.float32)
    for a in range(0, len(words), 4096):  # a word's subsequences are held for a block of words only
        phi[a : a + 4096] = Features(words[a : a + 4096]).kernel(landmarks, half)
    features = lambda block: np.column_stack([phi[block], np.ones(len(phi[block]), np.float32)])  # noqa: E731  the last one is the bias
    y, blocks = np.where(toxic, 1.0, -1.0), [slice(a, a + 4096) for a in range(0, len(words), 4096)]
    solved = []
    for weight in weights:
        # either class weighs as much as the other, and `penalty` does not depend on the number of sentences
        cost = weight * np.where(toxic, 1 / max(weight[toxic].sum(), 1e-9), 1 / max(weight[~toxic].sum(), 1e-9)) * penalty * 1000
        w = np.zeros(phi.shape[1] + 1)
        for _ in range(steps):
            hessian, right = np.eye(len(w)), np.zeros(len(w))
            for block in blocks:
                z = features(block)
                c = cost[block] * (y[block] * (z @ w) < 1)
                own = np.flatnonzero(c)
                z = z[own]
                hessian += z.T @ (z * c[own, None])
                right += z.T @ (c[own] * y[block][own])
            step = np.linalg.solve(hessian, right)
            settled = np.abs(step - w).max() < 1e-5
            w = step
            if settled:
                break
        solved.append(w)
    tables = np.zeros((len(solved), _CODES), dtype=np.float32)
    owner = np.repeat(np.arange(len(landmarks)), np.diff(landmarks.starts))
    for table, w in zip(tables, solved, strict=True):
        np.add.at(table, landmarks.codes, (half @ w[:-1])[owner] * landmarks.weights)
    return [Machine(t, float(w[-1])) for t, w in zip(tables, solved, strict=True)]


def _pooling(evidence: np.ndarray, toxic: np.ndarray, toxic_share: float, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the logistic over documents; the classes weigh as among all labelled ones."""
    z = _design(evidence)
    share = np.where(toxic > 0, toxic_share / max(1, (toxic > 0).sum()), (1 - toxic_share) / max(1, (toxic <= 0).sum()))
    w = np.array([1.0, 0, 0, 0, 0])
    hold = np.diag([ridge] * POOLED + [ridge, 0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (share * p * (1 - p))[:, None]) + hold + 1e-9 * np.eye(len(w)), z.T @ (share * (p - toxic)) + hold @ w)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _code_counts(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other documents that hold each subsequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, _CODES), dtype=np.int64)
        for batch in batches:
            raw, bounds = text_buffer(batch.column("text"))
            toxic = batch.column("_toxic").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                s = spell(raw[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
                here = np.zeros(_CODES, dtype=bool)
                for inside, code, _ in _codes(s.symbols, s.size):
                    here[code[inside]] = True
                seen[toxic[i]] += here
        code = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (code, seen[1][code], seen[0][code])], names=["code", "t", "c"])

    found = own.mapInArrow(run, "code bigint, t bigint, c bigint").groupBy("code").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toPandas()
    out = np.zeros((2, _CODES))
    out[:, found["code"].to_numpy(dtype=np.int64)] = found[["t", "c"]].to_numpy().T
    return out[0], out[1]


def _log_odds(toxic: np.ndarray, clean: np.ndarray, toxic_share: float, weight: float = 2.0) -> np.ndarray:
    """How much a subsequence raises the log-odds of toxicity; 0 for one that was never seen."""
    share = (np.maximum(toxic, 0) + weight * toxic_share) / (np.maximum(toxic, 0) + np.maximum(clean, 0) + weight)
    return np.log(share / (1 - share) * (1 - toxic_share) / toxic_share).astype(np.float32)


_OFFER = "_doc bigint, _toxic int, _fold int, word binary, margin double, random boolean, m0 double, m1 double, m2 double, size double"


def _offers(own: DataFrame, machines: list[Machine], choice: str, last: bool = False) -> pd.DataFrame:
    """The sentences that every document of the sample offers, by their witnesses, beside the document's evidence.

    ``choice`` is the column that says which machine looks at a document; the
    evidence is wanted of the ``last`` round only.  At most five short rows for
    each of the bounded number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_toxic", "_fold")]
            which = batch.column(choice).to_numpy(zero_copy_only=False)
            raw, bounds = text_buffer(batch.column("text"))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                machine = machines[which[i]]
                evidence = machine.evidence(batch.column("text").slice(i, 1))[0].tolist() if last else [0.0] * (POOLED + 1)
                s = spell(raw[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
                rows = []
                if len(s.size):
                    margin = machine.word_margins(s)
                    order = np.lexsort((-margin, s.sentence))
                    worst = order[np.concatenate([[True], np.diff(s.sentence[order]) != 0])]  # a witness for each sentence
                    worst = worst[s.size[worst] <= LONGEST + 2]
                    worst = worst[np.argsort(-margin[worst], kind="stable")]
                    worst = worst[np.concatenate([[True], np.diff(margin[worst]) != 0])] if len(worst) else worst
                    begin = np.cumsum(s.size) - s.size
                    word = lambda w: s.symbols[begin[w] + 1 : begin[w] + s.size[w] - 1].astype(np.uint8).tobytes()  # noqa: E731, B023
                    first = TOXIC_SENTENCES if columns[1][i] else WORST
                    rows = [(word(w), float(margin[w]), False) for w in worst[:first]]
                    if not columns[1][i] and len(worst) > first:
                        some = np.random.default_rng(int(columns[0][i]) & 0xFFFFFFFF).choice(len(worst) - first, min(RANDOM, len(worst) - first), False)
                        rows += [(word(w), float(margin[w]), True) for w in worst[first + some]]
                rows = rows or [(None, None, False)]
                out += [(*(int(c[i]) for c in columns), *r, *evidence) for r in rows]
            names = [f.split()[0] for f in _OFFER.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.bool_(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    found = own.mapInArrow(run, _OFFER).toPandas()
    return found.sort_values(["_doc", "_toxic", "margin", "word"], ascending=[True, True, False, True], ignore_index=True, kind="stable")


def train(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", toxic: str = "toxic"
) -> Machine:
    """A machine from the sentences of labelled documents.

    Learns from a sample of about 4,000 labelled documents of each class,
    those whose hashed id falls below the share that makes as many; texts that
    repeat count once.  Texts stay on the cluster; the driver gets counts of at
    most 64^3 subsequences and, in each round, at most five words of each
    sampled document.  Rows with a null id or label are left out, null texts
    have no words; an id with several labels is taken with each.  Without
    examples of both classes every document gets the same score.
    """
    slim = labels.select(F.col(doc).alias("_id"), (F.col(toxic) > 0).cast("int").alias("_toxic"))
    slim = slim.where("_id is not null and _toxic is not null").distinct()
    number = {r["_toxic"]: r["n"] for r in slim.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(number) < 2:
        return Machine(np.zeros(_CODES, np.float32), 0.0, np.array([0, 0, 0, 0, 5.0 if 1 in number else -5.0]))
    limit = F.when(F.col("_toxic") == 1, DOCUMENTS / number[1]).otherwise(DOCUMENTS / number[0])
    sample = slim.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < limit * (1 << 30))  # about 2 * DOCUMENTS rows of two numbers
    own = docs.select(F.col(doc).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.join(F.broadcast(sample), "_id").dropDuplicates(["text", "_toxic"])
    hashed = F.xxhash64("text")
    own = written(own.select("text", "_toxic", hashed.alias("_doc"), F.pmod(F.shiftright(hashed, 7), F.lit(FOLDS)).cast("int").alias("_fold")))
    t, c = _code_counts(own)
    share = number[1] / (number[0] + number[1])
    balance = min(max(float(own.agg(F.avg("_toxic")).first()[0] or 0), 1e-3), 1 - 1e-3)
    machines = [Machine(_log_odds(t, c - 1, balance), 0.0), Machine(_log_odds(t - 1, c, balance), 0.0)]
    offers, pool = _offers(own, machines, "_toxic"), pd.DataFrame()
    for k in range(ROUNDS):
        # all sentences that clean documents have offered so far; of toxic ones the worst, and those a machine calls toxic
        rank = offers.groupby(["_doc", "_toxic"]).cumcount()
        bad = (offers["_toxic"] == 1) & ((rank < (2 if k == 0 else 1)) | ((offers["margin"] > 0) & (k > 0)))
        fresh = offers[offers["word"].notna() & (bad | (offers["_toxic"] == 0))]
        pool = pd.concat([pool[pool["_toxic"] == 0], fresh]) if len(pool) else fresh
        counted = pool.groupby(["word", "_toxic", "_fold"])["_doc"].nunique().unstack(fill_value=0)
        named, is_toxic = counted.index.get_level_values(0).tolist(), counted.index.get_level_values(1).to_numpy() == 1
        folds = np.zeros((FOLDS, len(named)))
        folds[counted.columns.to_numpy(dtype=int)] = counted.to_numpy().T
        number_of = np.vstack([folds.sum(axis=0) - folds, folds.sum(axis=0)])
        # a square root of toxic ones, so that a frequent insult doesn't hide the rare ones
        *machines, machine = train_words(named, is_toxic, np.where(is_toxic, np.sqrt(number_of), number_of))
        offers = _offers(own, machines, "_fold", k == ROUNDS - 1)
    seen = offers.drop_duplicates(["_doc", "_toxic"])
    machine.pooling = _pooling(seen[["m0", "m1", "m2", "size"]].to_numpy(), seen["_toxic"].to_numpy().astype(float), share)
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Append ``toxicity`` (0 to 1) to every row; nothing but the text is looked at.

    Null, empty and sign-only texts score as a text whose words resemble
    nothing.  A column of that name is replaced; rows are never dropped.
    """
    docs = docs.drop("toxicity")
    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(machine.scores(machine.evidence(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def held_out(doc: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id's decimal text is 2 modulo 4 (null ids are not)."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels.where(~held_out()))
    return score(docs, machine).select(
        F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
    )
