"""Byte-level BPE encoding and decoding with given merge ranks.

The encoder keeps the mergeable pairs of a pre-token in a queue by merge rank:
one bucket of linked-list positions for each rank, and above the buckets a
bitmap of three levels that says which of them hold something. Find-first-set
on the bitmap gives the lowest rank at once. A merge leaves the entries of
the pairs that it changed where they are; they are recognised and skipped when
their turn comes. A pre-token of n bytes so takes about n queue operations,
however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free

#: Pre-tokens whose ids a worker keeps at most, besides those at hand, and characters that are encoded together. Results depend on neither.
CACHE, TOGETHER = 250_000, 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank. ``first`` is the lowest rank that has any, or -1.

    Levels of 64-bit words, kept sparsely: bit b of word w of a level says that
    word 64 w + b below it isn't zero (at the lowest level: that this rank's bucket
    isn't empty).
    """

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def _add(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, position: int) -> None:
        if bucket := self.buckets.get(rank):
            heappush(bucket, position)
        else:
            self._add(rank, [position])

    def push_all(self, rank: int, positions: list[int]) -> None:
        if bucket := self.buckets.get(rank):
            bucket.extend(positions)
        else:
            self._add(rank, positions)

    def first(self) -> int:
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The whole bucket, in no order."""
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.buckets.pop(rank)

    def pop(self, rank: int) -> int:
        """The leftmost position, of a bucket filled by ``push`` only."""
        bucket = self.buckets[rank]
        return heappop(bucket) if len(bucket) > 1 else self.take(rank)[0]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.number, self.packed = Numbers(), []
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], dtype=np.int32)
        self.width = max(ranks.values()) + 1
        pairs = {ranks[t[:k]] * self.width + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        follow, before = list(range(1, n + 1)), list(range(-1, n))  # a node is its first byte; it ends where the next begins
        pair, queue = [-1] * (n + 1), RankQueue()
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2], -1)) >= 0:
                pair[i] = rank
                queue.push(rank, i)
        while (rank := queue.first()) >= 0:
            i = queue.pop(rank)
            if pair[i] != rank:
                continue  # stale: a merge has changed this pair
            gone = follow[i]
            after = follow[i] = follow[gone]
            pair[gone] = -1
            before[after] = i
            for left in (before[i], i):
                if left >= 0:
                    right = follow[left]
                    pair[left] = now = ranks.get(piece[left : follow[right]], -1) if right < n else -1
                    if now >= 0:
                        queue.push(now, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : follow[i]]])
            i = follow[i]
        return ids

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks that pairs of ids merge to, or -1."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, packed, by one queue over all of them.

        As pre-tokens don't touch each other, all merges of the lowest rank can be
        done at once. Within a pre-token that is right unless one of them brings up
        a pair of lower rank, which would have to come before the next; such a
        pre-token is done anew by itself.
        """
        if not pieces:
            return []
        n = sum(map(len, pieces))
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.append(np.repeat(np.arange(len(pieces), dtype=np.int32), np.fromiter(map(len, pieces), np.int64, len(pieces))), np.int32(-1))
        follow, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        pair, alone, alive = np.full(n + 1, -1, np.int32), np.zeros(len(pieces), bool), np.ones(n, bool)
        token, queue = np.append(token, np.int32(0)), RankQueue()

        def renew(nodes: np.ndarray) -> np.ndarray:
            right = follow[nodes]
            now = np.where(owner[right] == owner[nodes], self.ranks_of(token[nodes], token[right]), -1)
            pair[nodes] = now
            some = now >= 0
            nodes, ranks = nodes[some], now[some]
            order = np.argsort(ranks, kind="stable")
            nodes, ranks = nodes[order].tolist(), ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(nodes)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    queue.push_all(int(ranks[a]), nodes[a:b])
            return now

        renew(np.arange(n))
        while (rank := queue.first()) >= 0:
            at = np.unique(np.array(queue.take(rank)))
            at = at[pair[at] == rank]  # the others are stale
            if len(at) > 1 and (linked := np.append(False, follow[at[:-1]] == at[1:])).any():
                begins = np.flatnonzero(~linked)  # in a run of pairs that overlap, every other one merges
                at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = follow[at]
            after = follow[gone]
            several = np.append(owner[at[1:]] == owner[at[:-1]], False)
            if several.any():
                several[1:] |= several[:-1]
                touch = np.flatnonzero(after[:-1] == at[1:])
                between = self.ranks_of(np.full(len(touch), rank), token[after[touch]])
                alone[owner[at[touch[(between >= 0) & (between < rank)]]]] = True
            token[at], follow[at], before[after] = rank, after, at
            pair[gone], alive[gone] = -1, False
            left = before[at]
            nodes = np.unique(np.concatenate([left[(left >= 0) & (owner[left] == owner[at])], at]))
            now = renew(nodes)
            if several.any() and (early := (now >= 0) & (now < rank)).any():
                alone[np.intersect1d(owner[nodes[early]], owner[at[several]])] = True
        ids = token[:-1][alive].astype("<i4").tobytes()
        ends = [0, *(4 * np.cumsum(np.bincount(owner[:-1][alive], minlength=len(pieces)))).tolist()]
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for k in np.flatnonzero(alone).tolist():
            out[k] = np.array(self.merge(pieces[k]), "<i4").tobytes()
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as 32-bit integers. The pre-tokens of ``TOGETHER``
        characters of text are numbered, new ones are merged together, and each text
        is put together from its numbers."""
        some: list[np.ndarray] = []
        size = 0
        for text in texts:
            some.append(np.fromiter(map(self.number.__getitem__, self.split.findall(text)), np.int32))
            size += len(text) + 1
            if size >= TOGETHER:
                yield from self._together(some)
                some, size = [], 0
        yield from self._together(some)

    def _together(self, texts: list[np.ndarray]) -> Iterator[bytes]:
        new = [p.encode("utf-8", "replace") for p in self.number.new]
        ids = [None if (whole := self.ranks.get(p)) is None else whole.to_bytes(4, "little") for p in new]
        hard = iter(self.merge_all([p for p, known in zip(new, ids) if known is None]))
        self.packed += [next(hard) if known is None else known for known in ids]
        self.number.new = []
        packed = self.packed
        for codes in texts:
            yield b"".join([packed[k] for k in codes.tolist()])
        if len(packed) > CACHE:
            self.number, self.packed = Numbers(), []


class Numbers(dict):
    """Numbers strings as they come; ``new`` lists those not yet seen to."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self[text] = k = len(self)
        self.new.append(text)
        return k


def _encoder(ranks: dict[bytes, int], pattern: str, _last: list = []) -> Encoder:  # noqa: B006  one for each worker process, so that what it knows outlives a task
    if not _last or _last[0].ranks is not ranks or _last[0].split.pattern != pattern:
        _last[:] = [Encoder(ranks, pattern)]
    return _last[0]


def _ids(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    parts = list(encoder.encode(t.as_py() or "" for t in texts))
    ends = [0, *accumulate(len(p) // 4 for p in parts)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))]))


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _plain(tokens: list[bytes], lists: pa.ListArray) -> pa.Array:
    return pa.array([b"".join([tokens[k] for k in x.values.to_numpy(zero_copy_only=False).tolist()]) if x.is_valid else b"" for x in lists], pa.binary())


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out`` array<int>: the ids of ``text``, or none for a null or empty one.

    ``pattern`` cuts a text to pre-tokens, each of which is encoded by itself;
    there are no special tokens. All other columns stay, but for one named ``out``,
    which is replaced. Rows keep their order and partitions: there is no shuffle.
    The ranks, of a fixed size, are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value, pattern)
        for texts in batches:
            yield _ids(encoder, texts)

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` binary: the bytes that the ids stand for. No ids or null: no bytes.

    An id that the vocabulary lacks fails the job. As bytes, for a run of ids need not be valid UTF-8.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _tokens(shared.value)
        for lists in batches:
            yield _plain(tokens, lists)

    return df.withColumn(out, plain(F.col(ids)))


def encode_and_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode``, in one pass through one Python worker."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = _encoder(shared.value, pattern), _tokens(shared.value)
        for texts in batches:
            lists = _ids(encoder, texts)
            yield pa.StructArray.from_arrays([lists, _plain(tokens, lists)], ["ids", "decoded"])

    rest = [c for c in df.columns if c not in (ids, decoded)]
    out = free("__both", df)
    got = df.withColumn(out, both(F.col(text)))
    return got.select(*rest, F.col(out)["ids"].alias(ids), F.col(out)["decoded"].alias(decoded))


def n_tokens(ids: str | Column) -> Column:
    return F.coalesce(F.size(ids), F.lit(0)).cast("long")


def query(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each document."""
    ranks = load_ranks(path)
    both = encode_and_decode(docs.select("doc_id", "text"), ranks, pattern)
    return both.select(
        "doc_id",
        n_tokens("ids").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
