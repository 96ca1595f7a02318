"""Fill-in-middle: texts cut in three at unit boundaries that a succinct bit vector finds.

A unit is a run of ASCII letters or any other single character. The UTF-8 bytes of
many texts lie end to end in one Arrow buffer; a bit for each byte says whether a unit
starts there. The bits are packed to 64-bit words, with the set bits before each block
of 512 and before each word of a block in two small directories. ``rank`` at the ends
of a text gives its number of units, ``select`` of a rank the byte of a cut, and a
second vector, of the bytes that start a character, tells the pieces' lengths in code
points. The pieces are then cut and joined as bytes in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free, slices

#: The marks before prefix, suffix and middle, the shares of plain texts and of suffix-first ones, in per cent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM = 10, 20
SEED = "1:"
CUTS = "struct<n:long,first:long,second:long,prefix_chars:long,middle_chars:long>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80  # all but continuation bytes


class Bits:
    """A packed bit vector that answers rank and select for arrays of questions."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros((len(packed) // 64 + 1) * 8, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        held = np.bitwise_count(words).reshape(-1, 8).astype(np.int64)
        self.inside = np.cumsum(held, axis=1) - held
        self.before = np.concatenate([[0], np.cumsum(held.sum(1))])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """The set bits before each place."""
        word = places >> 6
        low = self.words[word] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[places >> 9] + self.inside.reshape(-1)[word] + np.bitwise_count(low)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the set bit that has so many before it."""
        block = np.searchsorted(self.before, ranks, side="right") - 1
        left = ranks - self.before[block]
        word = (self.inside[block] <= left[:, None]).sum(1) - 1
        left = left - self.inside[block, word]
        bits = np.unpackbits(self.words[8 * block + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return 512 * block + 64 * word + (np.cumsum(bits, axis=1) <= left[:, None]).sum(1)


def cuts_of(data: np.ndarray, edges: np.ndarray, one: np.ndarray, other: np.ndarray) -> dict[str, np.ndarray]:
    """For the texts between ``edges`` in a buffer of bytes: units, and the cuts after ``one`` and ``other`` of them (modulo units + 1), in bytes and in code points."""
    leads, letter = _LEADS[data], _LETTER[data]
    units = leads.copy()
    units[1:] &= ~(letter[1:] & letter[:-1])
    start, end = edges[:-1], edges[1:]
    units[start[start < end]] = True
    units, characters = Bits(units), Bits(leads)
    ahead = units.rank(edges)
    n = np.diff(ahead)
    a, b = one % (n + 1), other % (n + 1)
    at = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place = end.copy()
        cut = k < n
        place[cut] = units.select((ahead[:-1] + k)[cut])
        at.append(place)
    read = [characters.rank(x) for x in (start, *at)]
    return {"n": n, "first": at[0] - start, "second": at[1] - start, "prefix_chars": read[1] - read[0], "middle_chars": read[2] - read[1]}


def cuts(text: Column, one: Column, other: Column) -> Column:
    """n (units), and for the cuts after ``one`` and ``other`` units (modulo n + 1): ``first``, ``second`` (bytes before each), ``prefix_chars``, ``middle_chars``. A null text is empty."""

    @F.arrow_udf(CUTS)
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, p, q in batches:
            p, q = p.to_numpy(zero_copy_only=False), q.to_numpy(zero_copy_only=False)
            parts = [cuts_of(data, edges, p[a:b], q[a:b]) for a, b, data, edges in slices(texts)]
            names = ("n", "first", "second", "prefix_chars", "middle_chars")
            found = [np.concatenate([x[k] for x in parts] or [np.zeros(0)]).astype(np.int64) for k in names]
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], names=names)

    return of(text, one, other)


def drawn(doc_id: Column, k: int, seed: str = SEED) -> Column:
    """The ``k``-th draw of a row, from 0: a number below 2^32 that its id alone decides. Null ids all draw alike."""
    told = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("long")


def transform(df: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, plain: int = PLAIN, spm: int = SPM, out: str = "output") -> DataFrame:
    """Adds ``out``, the transformed text, and the columns n, form, prefix_chars and middle_chars, in place of columns of these names.

    ``form`` is plain, psm or spm; plain texts have no lengths. A null or empty text, and one that holds a mark, is
    plain as it is, so that ``restore`` can always tell the pieces apart. Null ids draw as an id without digits; rows that come again are transformed alike.
    """
    cut, whole = free("__cut", df), free("__whole", df)
    one, other, third, fourth = (drawn(F.col(doc_id), k, seed) for k in range(4))
    t = df.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    t = t.withColumn(cut, cuts(F.col(whole), one, other))
    body = F.col(whole).cast("binary")

    def piece(start: Column, end: Column) -> Column:
        return F.substring(body, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    first, second = F.col(cut)["first"], F.col(cut)["second"]
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second), piece(second, F.octet_length(whole).cast("long"))
    marked = F.col(whole).contains(PREFIX) | F.col(whole).contains(SUFFIX) | F.col(whole).contains(MIDDLE)
    form = F.when((F.col(whole) == "") | marked | (third % 100 >= 100 - plain), "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    made = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col(whole))
    )
    others = {c: F.when(F.col("form") != "plain", F.col(cut)[c]) for c in ("prefix_chars", "middle_chars")}
    return t.withColumn("form", form).withColumns({out: made, "n": F.col(cut)["n"], **others}).drop(cut, whole)


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation. A plain text stays; another holds each mark once, as marks can't arise where pieces meet."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    t = transform(docs.select("doc_id", "text"))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS told FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(told, k, 8) AS BIGINT)) AS h FROM t
), v AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), w AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM v
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM w
"""
