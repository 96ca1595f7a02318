"""Removing long byte strings that occur before, over a whole corpus.

A byte goes if it is in a string of ``LENGTH`` bytes that also starts earlier: for the
suffix at every byte, whether its first LENGTH bytes are those of an earlier suffix.
Suffixes are sorted by buckets, with ranks of a difference cover:

1. The cover sample. ``COVER`` is a perfect difference set modulo ``PERIOD``: for any two places
   some d < PERIOD brings both to places whose remainders are in the set. So two equal strings
   have cover places d bytes after their starts, and the W = LENGTH - PERIOD + 1 bytes there,
   still within both strings, agree as well. Only cover places, eight of 57, are sorted, a bucket of
   contents (those W bytes) at a time, and ranked by content and then by context: all bytes
   of the strings that can use the place. A content alone in the corpus clears its place.
   Places of one rank have equal strings all along, and all but the first repeat it: long
   ties, such as those of copied texts, end here, without a look at their suffixes.
2. The suffixes that the ranks leave open: strings on the first place of a rank whose content has
   other ranks too (ends of passages, edits), unless another cover place has settled them.
   They are dealt to buckets by their own bytes (the least hash of K of them, which neighbours
   mostly share, so that their places pack well) and sorted a bucket at a time. Strings around a
   sentence of many documents all share its least hash: such crowded hashes are found beforehand in a sample,
   and their strings dealt by all their bytes. The sample only says where strings meet, not which.

Both times a task holds ``FLUSH`` rows, or one bucket's. Tasks first settle what they can by themselves and pass on one row for each rank or string,
so that a passage in a third of all documents makes as many rows as there are tasks. Of a
content with over ``HOT`` contexts in one task (a line of dashes), which is sure to
have several, only the first go on to the buckets; the rest are left open at once.

What a bucket knows of a text goes on to the part of the text, as packed runs, and is joined there once.
The second step takes as many turns as its rows need.

Places are compared by their bucket, 32 more bits of the same hash of the content, and 40 of one of the context,
strings by 64-bit hashes. Buckets hold as many contents in any corpus, so that two different ones are taken for one, which would
leave their strings open, in one of 2,400 places (``BUCKET_BYTES`` of text, 1.8 million places, of 2^32), whatever the size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_shuffles, rewritten

#: Bytes of a string.
LENGTH = 100
# A perfect difference set of order 7. Every remainder but 0 is the difference of just one pair.
COVER, PERIOD = (0, 1, 3, 13, 32, 36, 43, 52), 57
#: Bytes at a cover place that are in every string that has it within its first PERIOD bytes.
W = LENGTH - PERIOD + 1
#: Bytes whose least hash in a string says the string's bucket.
K = 24
#: Bytes hashed together; rows that a task sorts together; bytes of text for each bucket.
BUFFER, FLUSH, BUCKET_BYTES = 1 << 20, 400_000, 12 << 20
#: Buckets at least: about as many as a text has cover places, so that a text's places are as scattered in a small corpus as in a large one.
BUCKETS = 512
#: Parts of the texts at least, in which what the buckets tell comes together.
PARTS = 64
#: Suffix buckets are sorted in so many turns at least, of which each reads the texts anew: less disk at a time.
TURNS = 1
#: Bytes of a suffix in a shuffle, about: there are turns enough that those of one are no more than the texts.
SUFFIX_BYTES = 10
#: One text in so many, and one piece in so many of longer texts, shows which least hashes are crowded.
SAMPLE = 16
#: Strings of one least hash, by the sample, from which they are dealt by all their bytes; and as a share of all strings, which bounds the list of such hashes to 4 MB.
CROWD, CROWD_SHARE = 1 << 14, 1 / (1 << 20)
#: Contexts of one content that a task sends to be ranked at a time.
HOT = 256

U = np.uint64
STEP = 0x9E3779B97F4A7C15
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
RUN = np.dtype([("at", "<u4"), ("n", "<u4")])  # strings that start at ``at`` and the next n - 1 bytes


def _powers(base: int, n: int, _known: dict = {}) -> np.ndarray:  # noqa: B006  once for each process
    if len(_known.get(base, ())) < n:
        _known[base] = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, BUFFER + 1) - 1, base, U)]), dtype=U)
    return _known[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hashes:
    """Hashes of all substrings of a buffer, by their content alone: sums of byte values times powers, modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[data] * _powers(STEP, n)[:n], out=self.sums[1:])
        self.back = _powers(pow(STEP, -1, 1 << 64), n + 1)

    def least(self) -> np.ndarray:
        """For each string of LENGTH bytes the least hash of K of its bytes."""
        n = len(self.sums) - 1
        least, width, places = (_mix((self.sums[K:] - self.sums[:-K]) * self.back[: n - K + 1]) >> U(32)).astype(np.uint32), 1, LENGTH - K + 1
        while width < places:  # of twice as many places
            step = min(width, places - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        return least

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def _cover(n: int, _known: list = []) -> np.ndarray:  # noqa: B006  once for each process
    """The cover places below n."""
    if not _known or _known[0][-1] < n:
        periods = max(n, BUFFER) // PERIOD + 2
        _known[:] = [(np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()]
    return _known[0][: np.searchsorted(_known[0], n)]


def places(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each cover place: part, first start in the part of a string that uses it, number of starts, content and context."""
    some = [(k, len(p), at) for (k, p), at in zip(enumerate(parts), np.cumsum([0, *map(len, parts)])) if len(p) >= LENGTH]
    if not some:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    hashes = Hashes(np.frombuffer(b"".join(parts), np.uint8))
    each = [_cover(n - W + 1) for _, n, _ in some]
    owner, size, base = (np.repeat(np.array([s[j] for s in some], np.int64), [len(e) for e in each]) for j in range(3))
    q = np.concatenate(each)
    first = np.maximum(q - PERIOD + 1, 0)
    count = np.minimum(q, size - LENGTH) - first + 1
    content = _mix(hashes.of(base + q, base + q + W))
    context = hashes.of(base + first, base + first + count + LENGTH - 1)
    context = _mix(context + U(0xC2B2AE3D27D4EB4F) * (q - first).astype(U) + U(0x165667B19E3779F9) * count.astype(U))
    return owner, first, count, content, context


def pieces(rows: Iterable[tuple]) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray]]:
    """Rows (..., bytes) gathered to about BUFFER bytes: the rows without the bytes, the bytes and where in the text they begin. Longer texts are cut, overlapping by LENGTH - 1."""
    keys, parts, begins, size = [], [], [], 0
    for *key, text in rows:
        for at in range(0, max(1, len(text) - LENGTH + 1), BUFFER - LENGTH + 1):
            part = text[at : at + BUFFER]
            if size + len(part) > BUFFER and parts:
                yield keys, parts, np.array(begins)
                keys, parts, begins, size = [], [], [], 0
            keys.append(tuple(key))
            parts.append(part)
            begins.append(at)
            size += len(part)
    if parts:
        yield keys, parts, np.array(begins)


def _documents(ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's number in order, and the ids and ties by number."""
    order = np.lexsort([ties, ids]) if ties.any() else np.argsort(ids, kind="stable")
    ids, ties = ids[order], ties[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])) if len(ids) else np.zeros(0, bool)
    number = np.zeros(len(ids), np.int32)
    number[order] = np.cumsum(new) - 1
    return number, ids[new], ties[new]


def _settle(key: np.ndarray, rest: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (key, rest) and then by place; whether a row is the first of its kind. A row that comes again, as its document does, is left out."""
    order = np.argsort(key)
    first = np.append(True, key[order[1:]] != key[order[:-1]]) if len(key) else np.zeros(0, bool)
    several = np.flatnonzero(~(first & np.append(first[1:], True)))
    if not len(several):
        return order, first
    o = order[several]
    o = o[np.lexsort([at[o], doc[o], rest[o], key[o]])]
    new = np.append(True, (key[o[1:]] != key[o[:-1]]) | (rest[o[1:]] != rest[o[:-1]]))
    order[several], first[several] = o, new
    lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    keep = np.ones(len(order), bool)
    keep[several] = new | (doc[o] != doc[lead]) | (at[o] != at[lead])
    return order[keep], first[keep]


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # document, first start, number of starts


def _joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> Runs:
    """Runs by document and place, those that touch or overlap joined."""
    order = np.lexsort([at, doc])
    doc, at, n = doc[order], at[order].astype(np.int64), np.broadcast_to(n, len(doc))[order].astype(np.int64)
    if not len(doc):
        return doc, at, n
    shift = doc.astype(np.int64) << 32  # places are under 2^32
    reach = np.maximum.accumulate(at + n + shift)
    first = np.flatnonzero(np.append(True, ((at + shift)[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
    return doc[first], at[first], np.append(reach[first[1:] - 1], reach[-1]) - shift[first] - at[first]


#: Columns of a row that are packed, with their type and the bytes that they need, lowest first: places of the cover, suffixes, and runs.
PLACE = (("content", "<u4", 4), ("context", "<u8", 5), ("at", "<u4", 4), ("n", "<u4", 1))
SUFFIX = (("key", "<u8", 8), ("at", "<u4", 4))
SPAN = (("at", "<u4", 4), ("n", "<u4", 4))


#: Before them stand the id, as the step from the row before, and the tie.
OWN = (("id", "<u8", 8), ("tie", "<u8", 8))


def _cells(kind: tuple, columns: dict[str, np.ndarray], doc: np.ndarray, of: np.ndarray, keys: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> pa.Array:
    """The rows of each bucket in ``keys`` as bytes: all first bytes, then all second bytes and so on, which compresses well."""
    order = np.argsort(of.astype(np.uint16) if not len(keys) or keys[-1] < 1 << 16 else of, kind="stable")
    begin = np.searchsorted(of[order], keys)
    n = np.diff(np.append(begin, len(of)))
    own, leads = doc[order], begin[n > 0]
    id_ = ids[own].view(U)
    step = np.diff(id_, prepend=U(0))
    step[leads] = id_[leads]
    size = sum(width for *_, width in OWN + kind)
    data = np.zeros(size * len(of), np.uint8)
    at, rows, place = np.arange(len(of)) + np.repeat((size - 1) * begin, n), np.repeat(n, n), 0
    for (_, dtype, width), column in zip(OWN + kind, (step, ties[own], *(columns[name][order] for name, *_ in kind))):
        raw = np.ascontiguousarray(column).astype(dtype, copy=False).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize)
        for k in range(width):
            if raw[:, k].any():
                data[at + (place + k) * rows] = raw[:, k]
        place += width
    edges = (size * np.append(begin, len(of))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _together(kind: tuple, blobs: Iterable[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The columns of all blobs, the document of each row, and ids and ties of the documents."""
    size = sum(width for *_, width in OWN + kind)
    parts = [np.frombuffer(blob, np.uint8).reshape(size, -1) for blob in blobs if blob]
    data = np.concatenate(parts, axis=1) if parts else np.zeros((size, 0), np.uint8)
    whole, place = {}, 0
    for name, dtype, width in OWN + kind:
        column = np.zeros((data.shape[1], np.dtype(dtype).itemsize), np.uint8)
        column[:, :width] = data[place : place + width].T
        whole[name] = column.reshape(-1).view(dtype)
        place += width
    n = np.array([p.shape[1] for p in parts], np.int64)
    sums, begin = np.cumsum(whole["id"], dtype=U), np.cumsum(n) - n
    id_, tie = (sums - np.repeat(sums[begin] - whole.pop("id")[begin], n)).view(np.int64), whole.pop("tie").view(np.int64)
    new = np.append(True, (id_[1:] != id_[:-1]) | (tie[1:] != tie[:-1]))[: len(id_)]
    number, ids, ties = _documents(id_[new], tie[new])
    return whole, np.repeat(number, np.diff(np.append(np.flatnonzero(new), len(id_)))), ids, ties


def _dealt(kind: tuple, columns: dict, doc: np.ndarray, bucket: np.ndarray, buckets: int, known: Runs, unsure: Runs, ids: np.ndarray, ties: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: the rows to sort, and the runs that are known to be repeats, or left open, without it; these are dealt by their documents."""
    parts = [(kind, columns, doc, bucket), *((SPAN, {"at": at, "n": n}, d, (ids[d] + ties[d]) % buckets) for d, at, n in (known, unsure))]
    keys = np.unique(np.concatenate([of for *_, of in parts]))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[_cells(*part, keys, ids, ties) for part in parts]], ["bucket", "rows", "known", "unsure"])


BUCKETED = "bucket int, rows binary, known binary, unsure binary"
SPANS = "part int, repeats binary, unsure binary"
FOUND = "id long, tie long, repeats binary, unsure binary, starts long"
NO_RUNS = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _found(known: Runs, unsure: Runs, ids: np.ndarray, ties: np.ndarray) -> pd.DataFrame:
    """A row for each document with runs of a kind; ``starts`` in them."""
    parts = []
    for name, (doc, at, n) in (("repeats", known), ("unsure", unsure)):
        run = np.zeros(len(doc), RUN)
        run["at"], run["n"] = at, n
        blob, start = run.tobytes(), np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        edges = (8 * np.append(start, len(doc))).tolist()
        starts = np.add.reduceat(n, start) if len(doc) else n
        parts.append(pd.DataFrame({"id": ids[doc[start]], "tie": ties[doc[start]], name: pd.Series([blob[a:b] for a, b in zip(edges, edges[1:])], dtype=object), "starts": starts}))
    return pd.concat(parts).reindex(columns=["id", "tie", "repeats", "unsure", "starts"]).astype({"repeats": object, "unsure": object}).where(lambda x: x.notna(), None)


def _spans(group: pd.DataFrame, name: str, ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's runs after other documents (ids, ties): their documents' numbers go on from there."""
    columns, doc, more_ids, more_ties = _together(SPAN, group[name])
    return doc + len(ids), columns["at"].astype(np.int64), columns["n"].astype(np.int64), np.append(ids, more_ids), np.append(ties, more_ties)


def _bucket(content: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(content.astype(U)) % U(buckets)).astype(np.int64)


def _gathered(data: list[tuple], n: int) -> list[np.ndarray]:
    out = [np.concatenate(c) if data else np.zeros(0, np.int64) for c in zip(*data)] if data else [np.zeros(0, np.int64)] * n
    data.clear()
    return out


def _ranked(buckets: int):
    """Cover places of the texts, dealt to buckets by content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(3)))

        held: list[tuple] = []
        texts: list[tuple] = []
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            number, ids, ties = _documents(*_gathered(texts, 2))
            owner, at, n, content, bucket, context = _gathered(held, 6)
            doc = number[owner]
            key, context = content | context >> U(32), context >> U(24)
            order, first = _settle(key, bucket.astype(U) << U(8) | context & U(0xFF), doc, at)
            lead, again = order[first], order[~first]
            own = key[lead] >> U(32)
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            many = np.arange(len(lead)) - np.repeat(start, np.diff(np.append(start, len(lead)))) >= HOT
            known, unsure = (_joined(doc[x], at[x], n[x]) for x in (again, lead[many]))
            lead = np.sort(lead[~many])
            own = (key[lead] >> U(32)).astype(np.uint32)
            columns = {"content": own, "context": context[lead], "at": at[lead], "n": n[lead]}
            yield from _dealt(PLACE, columns, doc[lead], bucket[lead], buckets, known, unsure, ids, ties)

        for keys, parts, begins in pieces(rows()):
            owner, at, n, content, context = places(parts)
            before = sum(len(t[0]) for t in texts)
            texts.append((np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)))
            bucket = ((content & U(0xFFFFFFFF)) % U(buckets)).astype(np.int32)  # from other bits than those in the row, which tell apart a bucket's contents only
            held.append((owner + before, (at + begins[owner]).astype(np.uint32), n.astype(np.uint8), content & U(0xFFFFFFFF00000000), bucket, context))
            size += len(owner)
            if size >= FLUSH:
                yield from settled()
                size = 0
        yield from settled()

    return run


def _part(doc: np.ndarray, at: np.ndarray, parts: int, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Where the runs of a text come together: a longer one by pieces."""
    return (_mix((ids[doc] + ties[doc]).view(U) + U(STEP) * (at >> 20).astype(U)) % U(parts)).astype(np.int64)


def _rank(parts: int):
    """A bucket of cover places; what it tells of the texts, dealt to their parts."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, doc, ids, ties = _together(PLACE, group["rows"])
        n = x["n"].astype(np.int64)
        key = x["content"].astype(U) << U(32) | x["context"] >> U(8)
        order, first = _settle(key, x["context"] & U(0xFF), doc, x["at"])
        lead, again = order[first], order[~first]
        own = key[lead] >> U(32)
        edge = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
        shared = lead[~(edge & np.append(edge[1:], True))]
        runs = []
        for name, mine in (("known", again), ("unsure", shared)):
            d, at, count, ids, ties = _spans(group, name, ids, ties)
            runs.append(_joined(np.append(doc[mine], d), np.append(x["at"][mine].astype(np.int64), at), np.append(n[mine], count)))
        of = [_part(d, at, parts, ids, ties) for d, at, _ in runs]
        keys = np.unique(np.concatenate(of))
        known, unsure = (_cells(SPAN, {"at": at, "n": n}, d, p, keys, ids, ties).to_pylist() for (d, at, n), p in zip(runs, of))
        return pd.DataFrame({"part": keys.astype(np.int32), "repeats": pd.Series(known, dtype=object), "unsure": pd.Series(unsure, dtype=object)})

    return run


def _outside(runs: Runs, others: Runs) -> Runs:
    """What is in the joined runs and not in the others."""
    edges = []
    for doc, at, n in (runs, others):
        begin = (doc.astype(np.int64) << 32) + at
        edges += [begin, begin + n]
    step = np.repeat([1, -1, 2, -2], [len(e) for e in edges])
    edge = np.concatenate(edges)
    order = np.argsort(edge, kind="stable")
    edge, inside = edge[order], np.cumsum(step[order])
    some = np.flatnonzero((inside[:-1] == 1) & (edge[1:] > edge[:-1]))
    return edge[some] >> 32, edge[some] & 0xFFFFFFFF, edge[some + 1] - edge[some]


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """What all buckets tell of a part of the texts."""
    x, doc, ids, ties = _together(SPAN, group["repeats"])
    d, at, n, ids, ties = _spans(group, "unsure", ids, ties)
    number, ids, ties = _documents(ids, ties)
    known = _joined(number[doc], x["at"], x["n"])
    return _found(known, _outside(_joined(number[d], at, n), known), ids, ties)


def _within(runs: np.ndarray, begin: int, n: int) -> np.ndarray:
    """Which of the n places from ``begin`` are starts in the runs."""
    edge = np.zeros(n + 1, np.int32)
    at = runs["at"].astype(np.int64) - begin
    np.add.at(edge, np.clip(at, 0, n), 1)
    np.add.at(edge, np.clip(at + runs["n"], 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray, Hashes, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Pieces of the texts with their hashes and, for each part with any, its number, its places left open and their least hashes."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            for id_, tie, data, repeats, unsure in zip(*(b.column(k).to_pylist() for k in range(5))):
                text = zstandard.decompress(data)
                yield id_, tie, *(np.frombuffer(b"".join(r), RUN) for r in (repeats, unsure)), len(text), text

    for keys, parts, begins in pieces(rows()):
        hashes, base = Hashes(np.frombuffer(b"".join(parts), np.uint8)), np.cumsum([0, *map(len, parts)])
        least, found = hashes.least() if base[-1] >= LENGTH else None, []
        for k, (_, _, repeats, unsure, _) in enumerate(keys):
            n = len(parts[k]) - LENGTH + 1
            if n >= 1:
                at = np.flatnonzero(_within(unsure, begins[k], n) & ~_within(repeats, begins[k], n))
                found.append((k, at, least[at + base[k]]))
        yield keys, parts, begins, hashes, found


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """least, n: different open strings by least hash, in each piece; of texts longer than a piece, one in SAMPLE."""
    for keys, parts, begins, hashes, found in _opened(batches):
        base = np.cumsum([0, *map(len, parts)])
        strings, leasts = [np.zeros(0, U)], [np.zeros(0, np.uint32)]
        for k, at, least in found:
            piece = np.array([keys[k][0] + (int(begins[k]) << 20) & (1 << 64) - 1], U)
            if keys[k][4] <= BUFFER or _mix(piece)[0] % U(SAMPLE) == 0:
                start = at + base[k]
                strings.append(hashes.of(start, start + LENGTH))
                leasts.append(least)
        _, one = np.unique(np.concatenate(strings), return_index=True)
        value, n = np.unique(np.concatenate(leasts)[one], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], ["least", "n"])


def _crowded(counts: DataFrame) -> np.ndarray:
    """The least hashes of so many strings that these are dealt by all their bytes, in order."""
    counts = rewritten(counts.groupBy("least").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(CROWD / SAMPLE, total * CROWD_SHARE)).select("least").toPandas()
    return np.sort(hot["least"].to_numpy(np.uint32))


def _suffixes(buckets: int, turn: int, crowded: np.ndarray, turns: int = TURNS):
    """The suffixes that are left open and whose buckets' turn it is, dealt to buckets by their first LENGTH bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[tuple] = []
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            number, ids, ties = _documents(*_gathered(texts, 2))
            owner, at, key, bucket = _gathered(held, 4)
            doc = number[owner]
            order, first = _settle(key, np.zeros(len(key), np.uint8), doc, at)
            lead, again = np.sort(order[first]), order[~first]
            yield from _dealt(SUFFIX, {"key": key[lead], "at": at[lead]}, doc[lead], bucket[lead], buckets, _joined(doc[again], at[again], 1), NO_RUNS, ids, ties)

        for keys, parts, begins, hashes, found in _opened(batches):
            base, before = np.cumsum([0, *map(len, parts)]), sum(len(t[0]) for t in texts)
            texts.append((np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)))
            for k, at, least in found:
                bucket = _bucket(least, buckets)
                many = np.flatnonzero(np.isin(least, crowded)) if len(crowded) else np.zeros(0, np.int64)
                if len(many):
                    start = at[many] + base[k]
                    bucket[many] = _bucket(hashes.of(start, start + LENGTH), buckets)
                at, bucket = at[bucket % turns == turn], bucket[bucket % turns == turn]
                start = at + base[k]
                held.append((np.full(len(at), before + k, np.int32), (at + begins[k]).astype(np.uint32), _mix(hashes.of(start, start + LENGTH)), bucket))
                size += len(at)
            if size >= FLUSH:
                yield from settled()
                size = 0
        yield from settled()

    return run


def _sorted(group: pd.DataFrame) -> pd.DataFrame:
    x, doc, ids, ties = _together(SUFFIX, group["rows"])
    order, first = _settle(x["key"], np.zeros(len(doc), np.uint8), doc, x["at"])
    again = order[~first]
    d, at, n, ids, ties = _spans(group, "known", ids, ties)
    return _found(_joined(np.append(doc[again], d), np.append(x["at"][again].astype(np.int64), at), np.append(np.ones(len(again), np.int64), n)), NO_RUNS, ids, ties)


#: Stands for a null id. Rows with this id have a negative ``tie`` if it is their own, another if they have none.
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, tie and data of each row: a null id is after the largest one; ``tie`` tells texts of one id apart, by a 64-bit hash. It is 0 where no id comes twice."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("own"), data.alias("data")).select(F.coalesce("own", F.lit(LAST)).alias("id"), F.col("own").isNull().alias("none"), "data")
    alone = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    tie = F.lit(0).cast("long") if alone else F.xxhash64("data")
    sign = F.lit(-LAST - 1).cast("long")
    tie = F.when(F.col("id") != LAST, tie).when(F.col("none"), tie.bitwiseAND(F.lit(LAST))).otherwise(tie.bitwiseOR(sign))
    return rows.select("id", tie.alias("tie"), "data")


def _compressed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    coder = zstandard.ZstdCompressor(level=1)
    for data in batches:
        yield pa.array([coder.compress(x.as_py()) for x in data], pa.binary())


def packed(rows: DataFrame) -> DataFrame:
    """The rows with the texts compressed, for the shuffle."""
    return rows.withColumn("data", F.arrow_udf(_compressed, "binary")("data"))


def repeats(rows: DataFrame) -> DataFrame:
    """id, tie and runs of the strings that occur earlier, for each text of ``keyed`` rows that has any."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    buckets, parts = max(BUCKETS, math.ceil(size / BUCKET_BYTES)), max(PARTS, math.ceil(size / BUCKET_BYTES))
    found = rewritten(rows.mapInArrow(_ranked(buckets), BUCKETED).groupBy("bucket").applyInPandas(_rank(parts), SPANS).groupBy("part").applyInPandas(_merged, FOUND))
    free_shuffles(rows.sparkSession)  # the places of the cover are some three times the input
    unsure = found.groupBy("id", "tie").agg(F.collect_list("repeats").alias("repeats"), F.collect_list("unsure").alias("unsure")).where(F.size("unsure") > 0)
    left = found.where("unsure is not null").agg(F.coalesce(F.sum("starts"), F.lit(0))).first()[0]
    turns = max(TURNS, math.ceil(left * SUFFIX_BYTES / max(size, 1)))

    def joined(some: DataFrame) -> DataFrame:
        return packed(some).join(unsure, ["id", "tie"]).select("id", "tie", "data", "repeats", "unsure")

    sample = rows.where((F.octet_length("data") > BUFFER) | (F.pmod(F.xxhash64("id", "tie"), F.lit(SAMPLE)) == 0))
    crowded = _crowded(joined(sample).mapInArrow(_sampled, "least long, n long"))
    both = found.where("repeats is not null")
    for turn in range(turns):
        both = both.unionByName(rewritten(joined(rows).mapInArrow(_suffixes(buckets, turn, crowded, turns), BUCKETED).groupBy("bucket").applyInPandas(_sorted, FOUND)))
        free_shuffles(rows.sparkSession)
    return both.groupBy("id", "tie").agg(F.collect_list("repeats").alias("runs"))


def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for data, runs in batches:
        size, kept, removed, spans = [], [], [], []
        for text, blobs in zip(data, runs):
            text = zstandard.decompress(text.as_py())
            size.append(len(text))
            if not blobs.is_valid:
                kept.append(text)
                removed.append(0)
                spans.append(0)
                continue
            run = np.frombuffer(b"".join(blobs.as_py()), RUN)
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, run["at"], 1)
            np.add.at(edge, run["at"].astype(np.int64) + run["n"] + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
        yield pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["n_bytes", "kept", "n_removed", "n_spans"])


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row.

    A null text counts as empty, and texts of less than LENGTH bytes keep all. Documents stand in the order of their ids, null last;
    different texts of one id in an order of their own. Rows alike in id and text are one
    document, and have the same result. Strings are compared by hashes.
    """
    rows = keyed(docs, text, doc_id)
    got = packed(rows).join(repeats(rows), ["id", "tie"], "left").withColumn("x", F.arrow_udf(_without, "struct<n_bytes:long,kept:binary,n_removed:long,n_spans:long>")("data", "runs"))
    back = F.when((F.col("id") != LAST) | (F.col("tie") < 0), F.col("id")).alias("doc_id")
    return got.select(back, "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
