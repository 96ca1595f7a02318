"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster that would
    be a folder that the executors cannot share, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect garbage, on which Spark removes the shuffle files of plans that nothing refers to any more, such as those before a checkpoint."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores after it as it takes to be none of the tables' columns (case aside)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def two_level_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows that stand earlier in
    ``keys``' order, which is ``chunk`` and then ``order``.

    A running sum in one window would put all rows of a hot key in one task.
    Here a window only spans one chunk of a key, and a second one spans the
    key's chunk totals. With about the root of the row count as the number of
    chunks, both stay small.
    """
    from pyspark.sql import Window as W

    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("__total"))
    ahead = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(chunk).alias("__chunk"), F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__ahead"))
    on = F.col(chunk) == F.col("__chunk")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    got = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, on, "inner")
    return got.withColumn(out, F.col("__inside") + F.col("__ahead")).drop("__inside", "__ahead", "__chunk", *[f"__k{i}" for i in range(len(keys))])


#: A key is hot if one of this many rows or more has it: there are never more hot ones than this.
HOT = 1000


def looked_up(many: DataFrame, keys: list[str], one: DataFrame, its_keys: list[str], total: int | None = None) -> DataFrame:
    """The rows of ``many``, each with the other columns of the row of ``one`` that has its keys; null where none has.

    Any share of ``many`` may have one key. Hot keys, those of a HOT-th of its ``total`` rows
    (counted if not given), stay where they are and meet the at most HOT rows of ``one`` with them as a broadcast, and rows with a null key meet
    none; only the others are shuffled to their keys. ``one`` has each key once, and no column name of ``many``.
    """
    if total is None:
        total = many.count()
    values = [c for c in one.columns if c not in its_keys]
    own = [free(f"__hot{i}", many, one) for i in range(len(keys))]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()

    def same(a: list[str], b: list[str]) -> Column:
        on = F.lit(True)
        for x, y in zip(a, b):
            on = on & (F.col(x) == F.col(y))
        return on

    n = free("__n", many, one)
    counts = many.where(known).select(*[F.col(k).alias(o) for k, o in zip(keys, own)]).groupBy(*own).agg(F.count(F.lit(1)).alias(n))
    hot = counts.where(F.col(n) * HOT >= total).join(one, same(own, its_keys), "left").select(*own, *values)
    placed = many.join(F.broadcast(hot), same(keys, own), "left")
    stays = F.col(own[0]).isNotNull() | ~known
    cold = placed.where(~stays).select(*many.columns).join(one, same(keys, its_keys), "left")
    return placed.where(stays).select(*many.columns, *values).unionByName(cold.select(*many.columns, *values))


#: Bytes of texts that are scanned at once; a longer text is scanned alone.
SLICE = 1 << 21


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of an array of strings, with their bytes as they lie in the Arrow buffer and the edges between them. A null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, side="right")) - 1)
        yield a, b, data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        a = b
