"""What filters do to each other: for every order of five filters, what each step removes.

Texts are scanned where they lie in the Arrow buffer: a table look-up gives each byte's
class, prefix sums count characters and capitals between the edges of texts, and
starts and ends of words come from neighbouring classes. A text's words are sorted by
hash; neighbours of one hash are compared byte by byte, and a text in which two
different words share a hash is counted anew, exactly.

What a row fails is a mask of five bits. All that the orders need are the counts of the
32 masks in each part, so that 120 orders cost no more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import durable, slices

FILTERS = "ABCDE"
#: Words at least, per cent of words that are distinct at least, per cent of characters that are capitals at most, symbols that fail a text.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
COUNTS = "struct<words:long,distinct:long,chars:long,capitals:long,symbols:long>"
#: Words of more bytes are hashed one by one.
LONG = 256

_SPACE, _CAPITAL, _SYMBOL, _LEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, *range(9, 14)]] |= _SPACE
_CLASS[65:91] |= _CAPITAL
_CLASS[[ord(c) for c in SYMBOLS]] |= _SYMBOL
_CLASS[(np.arange(256) & 0xC0) != 0x80] |= _LEAD
#: Masks of the low 0 to 8 bytes of a 64-bit number.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], "<u8")


def _block(windows: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th eight bytes of words, zeros after their end."""
    return windows[start + 8 * k] & _LOW[np.minimum(size - 8 * k, 8)]


def hashes(windows: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each word, from eight bytes at a time."""
    got = (_block(windows, start, size, 0) + size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    left, k = np.flatnonzero(size > 8), 1
    long = size > LONG
    if long.any():
        left = left[~long[left]]
        for i in np.flatnonzero(long):
            got[i] = xxh64_intdigest(data[start[i] : start[i] + size[i]])
    while len(left):
        x = got[left]
        got[left] = (x ^ (x >> np.uint64(29)) ^ _block(windows, start[left], size[left], k)) * np.uint64(0xBF58476D1CE4E5B9)
        k += 1
        left = left[size[left] > 8 * k]
    return got ^ (got >> np.uint64(32))


def _same(windows: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b are the same bytes."""
    same = size[a] == size[b]
    left, k = np.flatnonzero(same), 0
    long = left[size[a[left]] > LONG]
    for i in long:
        p, q = a[i], b[i]
        same[i] = np.array_equal(data[start[p] : start[p] + size[p]], data[start[q] : start[q] + size[q]])
    left = left[size[a[left]] <= LONG]
    while len(left):
        p, q = a[left], b[left]
        equal = _block(windows, start[p], size[p], k) == _block(windows, start[q], size[q], k)
        same[left[~equal]] = False
        k += 1
        left = left[equal & (size[p] > 8 * k)]
    return same


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray, n: int, hash_of=hashes) -> np.ndarray:
    """The distinct words of each of ``n`` texts; ``text`` says whose each word is."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (text.astype(np.uint64) << (np.uint64(64) - bits)) | (hash_of(windows, data, start, size) >> bits)
    order = np.argsort(key)
    key = key[order]
    pair = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[pair], order[pair + 1]
    same = _same(windows, data, start, size, a, b)
    got = np.bincount(text, minlength=n) - np.bincount(text[a], minlength=n)
    for t in np.unique(text[a[~same]]):
        mine = np.flatnonzero(text == t)
        got[t] = len({data[s : s + z].tobytes() for s, z in zip(start[mine], size[mine])})
    return got


def scan(data: np.ndarray, edges: np.ndarray, hash_of=hashes) -> dict[str, np.ndarray]:
    """Counts of each text between ``edges`` in a buffer of bytes."""
    kind, n = _CLASS[data], len(edges) - 1
    within = (kind & _SPACE) == 0
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    held = edges[:-1] < edges[1:]
    at, to = edges[:-1][held], edges[1:][held] - 1
    first[at], last[to] = within[at], within[to]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    words = np.diff(np.searchsorted(start, edges))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((kind & _LEAD).astype(np.uint64) >> np.uint64(3) | (kind & _CAPITAL).astype(np.uint64) << np.uint64(31))])
    both = np.diff(sums[edges])
    symbols = np.diff(np.searchsorted(np.flatnonzero(kind & _SYMBOL), edges))
    text = np.repeat(np.arange(n), words)
    return {"words": words, "distinct": distinct(data, start, size, text, n, hash_of), "chars": both & np.uint64(0xFFFFFFFF), "capitals": both >> np.uint64(32), "symbols": symbols}


def counts(text: Column) -> Column:
    """words, distinct, chars, capitals (A-Z) and symbols of a whole text; a null one is empty. Memory is some 30 bytes for each byte of a slice of texts, or of the longest text."""

    @F.arrow_udf(COUNTS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("words", "distinct", "chars", "capitals", "symbols")
        for texts in batches:
            parts = [scan(data, edges) for _, _, data, edges in slices(texts)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in parts] or [np.zeros(0)]).astype(np.int64)) for k in names], names=names)

    return of(text)


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, mask (bit k is set where filter k fails), good, toxic (booleans) and n, the rows that have them.

    A null id is above all others, and a text that null ids alone have is no copy; rows that share id and text are no copies of
    each other. An id with several labels is good, or toxic, if one of them says so. Texts are told apart by SHA-256 and don't leave their task.
    Rows of one text meet only as partial minima and in a join by text and id, so that the copies of one text are spread by their ids.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    t = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), counts(whole).alias("c"))
    c = F.col("c")
    fails = (c["words"] < WORDS, 100 * c["distinct"] < DISTINCT * c["words"], 100 * c["capitals"] > CAPITALS * c["chars"], c["symbols"] > 0)
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    rows = durable(t.select("id", "part", "digest", mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    # rows without an id match no label: their second key spreads them
    apart = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    told = told.withColumn("__apart", F.lit(0).cast("long"))
    rows = rows.withColumn("apart", apart).join(told, (F.col("id") == F.col("__id")) & (F.col("apart") == F.col("__apart")), "left")
    rows = rows.select("id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    least = rows.groupBy("digest").agg(F.min("id").alias("__least")).withColumnRenamed("digest", "__digest")
    rows = rows.join(least, (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__least")), "left")
    copy = F.when(F.col("__digest").isNull(), 1 << 4).otherwise(0)
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of filters and step, from the counts of the masks."""
    size = 1 << len(filters)
    places = F.col("n")
    by_mask = masks.groupBy("part").agg(
        *[
            F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & among, places)), F.lit(0)).cast("long") for m in range(size)]).alias(name)
            for name, among in (("all", F.lit(True)), ("good", F.col("good")), ("bad", F.col("toxic")))
        ]
    )
    steps = []
    for order in permutations(range(len(filters))):
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(filters[x] for x in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(1 << x for x in order[:k])).alias("before"), F.lit(1 << f).alias("bit")))
    t = by_mask.select("part", "all", "good", "bad", F.explode(F.array(*steps)).alias("s")).select("part", "all", "good", "bad", "s.*")
    n_orders = len(steps) // len(filters)

    def total(values: str, holds) -> Column:
        told = F.transform(F.col(values), lambda n, m: F.when(holds(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(told, F.lit(0).cast("long"), lambda a, x: a + x)

    before, bit = F.col("before"), F.col("bit")

    def here(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    shares = F.transform(F.col("all"), lambda n, m: F.when(m.bitwiseAND(bit) != 0, n * F.floor(F.lit(n_orders) / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(F.lit(0).cast("long")))
    return t.select(
        "part", "filter_order", "step",
        total("all", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("all", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("bad", here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs.select("doc_id", "lang", "text"), labels))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), least AS (
  SELECT text, min(doc_id) AS first_id FROM t GROUP BY text
), m AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text),
    regexp_matches(t.text, '[#$%&*|]'), first_id IS NOT NULL AND (t.doc_id IS NULL OR t.doc_id > first_id)] AS f
  FROM t JOIN least ON t.text = least.text LEFT JOIN l ON t.doc_id = l.doc_id
), g AS (
  SELECT part, f, good, toxic, count(*) AS n, len(list_filter(f, lambda x: x)) AS fails FROM m GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, list_transform(string_split(filter_order, ''), lambda y: ascii(y) - 64) AS o FROM orders, range(1, 6) r(s)
), j AS (
  SELECT g.*, filter_order, step, f[o[step]] AS here, len(list_filter(o[1:step - 1], lambda y: f[y])) > 0 AS earlier FROM g, steps
)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (here AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (here AND fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (here AND NOT earlier AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (here AND NOT earlier AND toxic = 1), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(fails, 1))) FILTER (here), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step
"""
