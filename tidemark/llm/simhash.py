"""Near-duplicates by SimHash, joined in an embedding of segment popcounts.

A 64-bit fingerprint is cut to 32 segments of two bits. The bits set in each give a
point with 32 coordinates of 0, 1 or 2, and the Manhattan distance of two points is
never more than the Hamming distance of their fingerprints. With the bits of each
segment sorted (01 and 10 alike), the distance of two points is the number of
bits in which they differ, so that a point is one long.

The coordinates form groups. Points within distance d differ in at most d
groups, and agree wholly in the others: they share a cell of the grid over some
all but d of the groups. Fingerprints are joined by cell, and pairs within the
distance are verified on the fingerprints, both as conditions of the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import durable, free
from tidemark.llm.graph import components

SHINGLE, SEED = 4, 42
#: Bits in which linked fingerprints differ at most; groups of segments that make the grid.
DISTANCE = 4
#: Groups of segments that make the grid, and the number of fingerprints up to which they do: more groups make more and smaller cells.
GROUPS = ((6, 1 << 21), (8, 1 << 28), (12, None))
#: A cell with more fingerprints links them by the points between them, not in pairs.
CELL = 4096
#: A fingerprint is hot if one of this many rows or more has it: there are never more hot ones than this.
HOT = 1000
ODD_BITS = 0x5555555555555555


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words. Only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # for bytes, at ASCII white space
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        stop = min(count, at + (1 << 16))
        parts = map(b" ".join, zip(*(words[at + k : stop + k] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([xxh64_intdigest(x, SEED) for x in parts], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > count).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds ``out`` long: the fingerprint of the whole text, read as signed."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint_of(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())

    return df.withColumn(out, of(F.col(text)))


def embedding(fp: Column) -> Column:
    """The point: two bits for each segment, 00, 01 or 11 for none, one or both bits set."""
    odd = F.lit(ODD_BITS)
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(odd), 1))


def _masks(groups: int) -> list[int]:
    """Disjoint masks of whole segments, as signed numbers."""
    edges = [2 * round(32 * k / groups) for k in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def groups_for(n: int) -> int:
    return next(g for g, most in GROUPS if most is None or n <= most)


def _between(distance: int) -> list[int]:
    """Masks of up to half of ``distance`` bits, as signed numbers."""
    masks = [sum(1 << b for b in some) for n in range(distance // 2 + 1) for some in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def crowded(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect what lies within ``distance``, an even one, and nothing else; not all are that near themselves.

    As many rows are made as fingerprints have points about them. Each takes the least node that any of its points has as its label, and
    the labels that meet at a point are linked to the least of them: in a crowd, labels are few.
    """
    node = F.struct("none", "least", "fp")
    masks = F.array(*map(F.lit, _between(distance)))
    about = fps.select(node.alias("b"), F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    least = about.groupBy("at").agg(F.min("b").alias("a"))
    labels = durable(about.join(least, "at").groupBy("b").agg(F.min("a").alias("a")))
    met = about.join(labels, "b").select("at", "a").distinct()
    low = met.groupBy("at").agg(F.min("a").alias("m"), F.max("a").alias("most")).where("m < most").select("at", "m")
    between = met.join(low, "at").where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    return labels.where("a < b").select("a", "b").unionByName(between)


def links(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS[0][0], cell: int = CELL) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``: each pair that differs in 1 to ``distance`` bits, but for those in cells of more than ``cell``, which
    have links enough to connect them and no others. A node is (none, least, fp), with the columns ``none`` and ``least``."""
    masks = _masks(groups)
    chosen = list(combinations(range(groups), groups - distance))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col("point").bitwiseAND(F.lit(sum(masks[g] for g in part))).alias("cell")) for k, part in enumerate(chosen)])
    placed = fps.select("none", "least", "fp", embedding(F.col("fp")).alias("point")).select("none", "least", "fp", "point", F.explode(cells).alias("c")).select("none", "least", "fp", "point", "c.k", "c.cell")
    full = durable(placed.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("k", "cell"))
    if full.isEmpty():
        return _pairs(placed, chosen, masks, distance)
    # the first cell that a pair shares decides where it is looked for: in one that isn't full, or among all that stand in full ones
    crowd = durable(placed.join(full, ["k", "cell"], "left_semi").select("none", "least", "fp").distinct())
    inside = crowd.select(F.col("fp").alias("__fp"), F.lit(True).alias("crowded"))
    marked = placed.join(full.withColumn("full", F.lit(True)), ["k", "cell"], "left").join(inside, F.col("fp") == F.col("__fp"), "left").drop("__fp")
    free_ = marked.where("full is null").drop("full")
    return _pairs(free_, chosen, masks, distance, anywhere=True).unionByName(crowded(crowd, distance)).distinct()


def _pairs(placed: DataFrame, chosen: list, masks: list[int], distance: int, anywhere: bool = False) -> DataFrame:
    """Pairs within the distance, each in the first cell that the two share; ``anywhere`` in all that they share, but for two that are both crowded."""
    a, b = placed.alias("a"), placed.alias("b")
    apart = F.col("a.point").bitwiseXOR(F.col("b.point"))
    if anywhere:
        once = ~(F.col("a.crowded").isNotNull() & F.col("b.crowded").isNotNull())
    else:
        first = F  # the first cell that the two share
        for k, part in enumerate(chosen):
            first = first.when(apart.bitwiseAND(F.lit(sum(masks[g] for g in part))) == 0, k)
        once = first == F.col("a.k")
    near = (
        (F.col("a.k") == F.col("b.k")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
        & once
    )
    return a.join(b, near).select(F.struct("a.none", "a.least", "a.fp").alias("a"), F.struct("b.none", "b.least", "b.fp").alias("b"))


def group(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id for each row: the smallest id among all texts that links lead to.

    Equal fingerprints are one node, whatever their number, so that copies make no pairs. A null
    text counts as one without words, which all have fingerprint 0. Null ids are passed over by the
    smallest one, which is null if there is no other.
    """
    return _grouped(df, text, doc_id).select("doc_id", "fp", "component_id")


def _grouped(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As ``group``, with ``hash`` of the text and ``root`` of the group: two groups have one component_id where texts share an id."""
    rows = durable(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fp", F.xxhash64("text").alias("hash")))
    # nodes are ordered by their smallest id, those without one last, so that a component's least node has the component's smallest id
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").isNull().alias("none"), F.min("doc_id").cast("long").alias("least"), F.count(F.lit(1)).alias("n")))
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    linked = components(links(nodes, groups=groups_for(n_nodes)))
    rooted = durable(nodes.join(linked, F.col("fp") == F.col("node.fp"), "left").select(F.col("fp").alias("__fp"), F.coalesce("root", F.struct("none", "least", "fp")).alias("root"), (F.col("n") * HOT >= n_rows).alias("hot")))
    # rows of hot fingerprints, at most HOT ones, stay where they are; the others go to their fingerprints
    hot = F.broadcast(rooted.where("hot").select(F.col("__fp").alias("__hot"), F.col("root").alias("hot_root")))
    placed = rows.join(hot, F.col("fp") == F.col("__hot"), "left")
    cold = placed.where("__hot is null").select("doc_id", "fp", "hash").join(rooted.where("not hot"), F.col("fp") == F.col("__fp")).select("doc_id", "fp", "hash", "root")
    both = placed.where("__hot is not null").select("doc_id", "fp", "hash", F.col("hot_root").alias("root")).unionByName(cold)
    return both.select("doc_id", "fp", F.col("root.least").alias("component_id"), "hash", F.col("root.fp").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest id, with all columns. Rows alike in id and text
    are one document; of different texts of the smallest id in one group that with the least hash stays. Rows without an id all stay, as none can be named."""
    id_, least, own = (free(x, docs) for x in ("__id", "__kept", "__hash"))
    kept = _grouped(docs).where("doc_id = component_id").groupBy("root").agg(F.first("component_id").alias(id_), F.min("hash").alias(least))
    hashed = docs.where("doc_id is not null").withColumn(own, F.xxhash64("text"))
    some = hashed.join(kept, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(least)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return some.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return group(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
