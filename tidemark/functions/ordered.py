"""Medians of growing sets: of all rows before each row, without sorting anew."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.kept import kept

#: Rows of a time block, and of a rank bucket, at least; the root of the rows, if that is more.
LEAST = 256


def ranked(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: a row's place by (value, i), from 0. Ranges of values are numbered by themselves, and start where those below them end."""
    x = kept(rows.repartitionByRange(value, "i").withColumn("__part", F.spark_partition_id()))
    ahead = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = x.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", ahead.alias("__ahead"))  # one row for each partition
    place = F.row_number().over(W.partitionBy("__part").orderBy(value, "i")) - 1
    return x.join(F.broadcast(starts), "__part").withColumn(out, F.col("__ahead") + place).drop("__part", "__ahead")


def expanding_median(rows: DataFrame, value: str, out: str, size: int | None = None) -> DataFrame:
    """Adds ``out`` to rows (i, value, ...), i counting them from 0 in their order: the median of the values of all rows before; null for the first row.

    Rows are ranked by value once. Counts by (time block, rank bucket), added up along both, tell
    for each time block in which buckets the median of all before it can move while the block passes: as many ranks up or down
    as the block has rows. Only the values of these buckets meet the block's own, in one Arrow group of a few times its length.
    No value is null.
    """
    x = kept(ranked(rows.select("i", F.col(value).cast("double").alias("v")), "v", "rank"))
    n = x.count()
    size = size or max(LEAST, int(n**0.5) + 1)
    x = x.withColumn("time", F.expr(f"i div {size}")).withColumn("bucket", F.expr(f"rank div {size}"))
    blocks = -(-n // size)
    cells = rows.sparkSession.range(blocks).select(F.col("id").alias("time"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long"))).alias("bucket"))  # as many as rows
    counted = cells.join(x.groupBy("time", "bucket").agg(F.count(F.lit(1)).alias("n")), ["time", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = counted.withColumn("n", F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("time").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    summed = before.withColumn("upto", F.sum("n").over(W.partitionBy("time").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    held = F.col("time") * size
    low, high = F.floor((held - 1) / 2) - size, F.least(held - 1, F.floor((held + size) / 2) + 1)
    within = summed.where((F.col("upto") > F.greatest(low, F.lit(0))) & (F.col("upto") - F.col("n") <= high) & (F.col("n") > 0))
    wanted = within.select(F.col("time").alias("at"), "bucket", (F.col("upto") - F.col("n")).alias("below"))
    base = x.select("bucket", "time", "rank", "v").join(wanted, "bucket").where(F.col("time") < F.col("at")).select(F.col("at").alias("time"), F.lit(-1).cast("long").alias("i"), "rank", "v", "below")
    own = x.select("time", "i", "rank", "v", F.lit(None).cast("long").alias("below"))

    def one(pdf):
        import pandas as pd

        mine, known = pdf[pdf["i"] >= 0].sort_values("i"), pdf[pdf["i"] < 0].sort_values("rank")
        first = int(mine["i"].iloc[0]) if len(mine) else 0
        ranks, values = known["rank"].tolist(), dict(zip(known["rank"], known["v"]))
        below = int(known["below"].min()) if ranks else 0  # values that stand below those at hand
        found = []
        for k, rank, v in zip(range(first, first + len(mine)), mine["rank"].tolist(), mine["v"].tolist()):
            a, b = ((k - 1) // 2 - below, k // 2 - below) if k else (None, None)
            found.append((values[ranks[a]] + values[ranks[b]]) / 2 if k else None)
            values[rank] = v
            insort(ranks, rank)
        return pd.DataFrame({"__i": mine["i"], "__m": found})

    made = own.unionByName(base).groupBy("time").applyInPandas(one, "__i long, __m double")
    return rows.join(made, F.col("i") == F.col("__i")).withColumn(out, F.col("__m")).drop("__i", "__m")
