"""Byte-level BPE encoding and decoding with given merge ranks.

Every match of the split pattern (a pre-token) is encoded by itself.  The
merges of a pre-token run over a doubly linked list of symbols; a rank queue
says which merge comes next.  The queue is a bitmap over merge ranks with a
summary level above it, so the smallest waiting rank is found by two
find-first-sets, whatever the pre-token's length.
A bucket per rank holds the list positions whose pair has that rank; entries
that a merge has made stale are skipped when they come up.  A pre-token of n
bytes takes O(n log n) steps (a bucket is a heap, as positions of one rank
merge from left to right).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pre-tokens that a worker remembers in each of two generations; longer ones than LONGEST_KEPT characters are never kept.
REMEMBERED, LONGEST_KEPT = 280_000, 40


class ByteBpe:
    """Encoder and decoder of one rank table.

    A pair's merge rank is the rank of the two symbols' joined bytes; symbols
    of the result are looked up again, so a table in which some byte has no
    rank raises KeyError for texts that need it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        self.bits = max(1, size.bit_length() + 1 >> 1)
        self.mask = (1 << self.bits) - 1
        self.low = [0] * ((size >> self.bits) + 1)
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token.

        The rank queue has two bitmap levels: bit w of ``top`` says that word w
        of ``low`` is not zero, and bit b of that word that rank (w << bits) + b
        has a bucket.  Words are as wide as the square root of the number of
        ranks, so either level is searched by one find-first-set.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return (whole,)
        bits, mask, low = self.bits, self.mask, self.low  # all of low is 0 between calls
        top, buckets, n = 0, {}, len(piece)
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise, so the list is a heap
                else:
                    buckets[rank] = [i]
                    low[rank >> bits] |= 1 << (rank & mask)
                    top |= 1 << (rank >> bits)
        ends = list(range(1, n + 2))  # ends[i]: where the symbol that begins at i ends; 0 if none begins there
        before = list(range(-1, n))
        while top:
            word = (top & -top).bit_length() - 1
            row = low[word]
            rank = (word << bits) + (row & -row).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = row = row & (row - 1)
                if not row:
                    top &= top - 1
            middle = ends[i]
            if not middle or middle == n:
                continue
            to = ends[middle]
            if rank_of(piece[i:to]) != rank:
                continue  # stale: one of the two symbols has changed
            ends[i], ends[middle] = to, 0
            left = before[i]
            if to < n:
                before[to] = i
            for first, last in ((i, ends[to] if to < n else 0), (left, to if left >= 0 else 0)):
                rank = rank_of(piece[first:last]) if last else None
                if rank is None:
                    continue
                if rank in buckets:
                    heappush(buckets[rank], first)
                else:
                    buckets[rank] = [first]
                    low[rank >> bits] |= 1 << (rank & mask)
                    top |= 1 << (rank >> bits)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            to = ends[i]
            out.append(ranks[piece[i:to]])
            i = to
        return tuple(out)

    def _new(self, pretoken: str) -> str:
        """Decimal ids of a pre-token that the last generation doesn't hold."""
        entry = self.kept.get(pretoken) or self.older.get(pretoken)
        if entry is None:
            entry = ",".join(map(str, self.merge(pretoken.encode("utf-8", "replace"))))
        if len(pretoken) <= LONGEST_KEPT:
            if len(self.kept) >= REMEMBERED:
                self.older, self.kept = self.kept, {}
            self.kept[pretoken] = entry
        return entry

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, as int64, and in decimal, joined by commas."""
        kept, new = self.kept.get, self._new
        decimal = ",".join([kept(match) or new(match) for match in self.split.findall(text)])
        return np.fromstring(decimal, dtype=np.int64, sep=","), decimal

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + lengths, lengths)].tobytes()


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


_models: dict[tuple[str, str], ByteBpe] = {}


def model(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, built once in each worker process."""
    if (path, pattern) not in _models:
        with open(path, "rb") as file:
            _models[path, pattern] = ByteBpe(read_ranks(file), pattern)
    return _models[path, pattern]


def _map_text(docs: DataFrame, text: str, added: str, row) -> DataFrame:
    """Append columns that ``row`` makes of one text, a batch at a time."""
    fields = StructType.fromDDL(added)
    names = fields.names
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                rows = [row(value) for value in part.column(text).to_pylist()]
                more = [pa.array([r[k] for r in rows], target.field(name).type) for k, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Append ``ids`` (array of long) and ``n_tokens`` to every row.

    A null or empty text has no ids.  Rows are never dropped or reordered;
    equal rows stay.  A column of ``docs`` named ``ids`` or ``n_tokens`` is
    replaced.  The rank file at ``path`` must be readable on the executors.
    """

    def row(value: str | None) -> tuple[list[int], int]:
        ids, _ = model(path, pattern).encode(value or "")
        return ids, len(ids)

    return _map_text(docs, text, "ids array<bigint>, n_tokens bigint", row)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded`` (binary): the bytes that ``ids`` stand for; null ids have none."""

    def row(value: list[int] | None) -> tuple[bytes]:
        return (model(path, pattern).decode(np.array(value or [], dtype=np.int64)),)

    return _map_text(encoded, ids, "decoded binary", row)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The digests are of the decimal ids joined by commas and of the bytes that
    the ids decode to, in lowercase hex.  Encodes and decodes in one pass, so
    no ids are moved.  Nulls, clashing names and repeated rows: as ``encode``.
    """

    def row(value: str | None) -> tuple[int, str, str]:
        bpe = model(path, pattern)
        ids, decimal = bpe.encode(value or "")
        digest = hashlib.sha256(decimal.encode()).hexdigest()
        return len(ids), digest, hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _map_text(docs, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and digests under the multilingual 50k ranks."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(docs, path, public_tokenizers.PATTERN).select(
        F.col("doc_id").cast("long"), "n_tokens", "ids_sha256", "decoded_sha256"
    )
