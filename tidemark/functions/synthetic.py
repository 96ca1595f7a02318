"""Series made up from hashed counters: the same on every run and under every partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.kept import kept

#: Rows that a task makes, by and by.
ROWS = 1 << 17


def uniform(*key: Column | str) -> Column:
    """A number within (0, 1) from the md5 of a key."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(*key: Column | str) -> Column:
    """By Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(F.lit("a"), *key))) * F.cos(2 * F.pi() * uniform(F.lit("b"), *key))


def white_noise(spark: SparkSession, n: int, n_series: int = 1) -> DataFrame:
    """series_id, i, r."""
    grid = spark.range(n_series * n).select(F.expr(f"id div {n}").alias("series_id"), (F.col("id") % n).alias("i"))
    return grid.withColumn("r", normal("series_id", "i"))


def random_walk(spark: SparkSession, n: int, n_series: int = 1) -> DataFrame:
    return white_noise(spark, n, n_series).select("series_id", "i", F.sum("r").over(W.partitionBy("series_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).alias("x"))


def ar1(spark: SparkSession, n: int, phi: float = 0.5, n_series: int = 1, block: int = 128) -> DataFrame:
    """series_id, i, r: r of row 0 is 0, then phi times the one before plus noise.

    A fold over each series' noise, by blocks: what a step appends to is a block, and what a block appends to is the list of blocks.
    """
    noise = white_noise(spark, n, n_series).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: F.when(x["i"] > 0, x["r"]).otherwise(0.0)).alias("e"))
    step = lambda a, e: F.concat(a, F.array(F.element_at(a, -1) * phi + e))

    def of_block(state: Column, part: Column) -> Column:
        made = F.slice(F.aggregate(part, F.array(state["last"]), step), 2, block)
        return F.struct(F.element_at(made, -1).alias("last"), F.concat(state["blocks"], F.array(made)).alias("blocks"))

    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<array<double>>").alias("blocks"))
    parts = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // block)), lambda k: F.slice("e", k * block + 1, F.lit(block)))
    made = noise.select("series_id", F.flatten(F.aggregate(parts, start, of_block, lambda x: x["blocks"])).alias("r"))
    return made.select("series_id", F.posexplode("r").alias("i", "r")).select("series_id", F.col("i").cast("long"), "r")


def fgn(spark: SparkSession, settings: list[tuple[int, float, int]]) -> DataFrame:
    """n, true_h, seed, i, r for each (n, H, seed): fractional Gaussian noise by circulant embedding, one series a group.

    Written once: Spark takes what a group makes to be as small as its setting, and would broadcast millions of rows, or make them all in one task.
    """

    def one(pdf):
        import pandas as pd

        n, h, seed = int(pdf["n"].iloc[0]), float(pdf["true_h"].iloc[0]), int(pdf["seed"].iloc[0])
        half = 1 << int(np.ceil(np.log2(max(n, 2))))
        k = np.arange(half + 1)
        cov = 0.5 * (np.abs(k - 1.0) ** (2 * h) - 2 * k ** (2 * h) + (k + 1.0) ** (2 * h))
        power = np.fft.fft(np.concatenate([cov, cov[-2:0:-1]])).real
        if power.min() < -1e-10:
            raise ValueError("the embedding has a negative eigenvalue")
        rng = np.random.default_rng([seed, int(1000 * h), n])
        z = rng.standard_normal(2 * half) + 1j * rng.standard_normal(2 * half)
        r = np.fft.fft(np.sqrt(np.maximum(power, 0) / (2 * half)) * z).real[:n]
        return pd.DataFrame({"n": n, "true_h": h, "seed": seed, "i": np.arange(n), "r": r})

    schema = "n long, true_h double, seed long, i long, r double"
    parts = max(1, min(len(settings), sum(n for n, _, _ in settings) // ROWS))
    each = spark.createDataFrame(settings, "n long, true_h double, seed long").repartition(parts, "n", "true_h", "seed")
    return kept(each.groupBy("n", "true_h", "seed").applyInPandas(one, schema))


def shuffles(rows: DataFrame, reps: int) -> DataFrame:
    """rows (ticker, i, r) with each ticker's returns in ``reps`` other orders, drawn by hash; ticker becomes ticker|rep."""
    order = W.partitionBy("ticker", "rep").orderBy(F.md5(F.concat_ws(":", F.col("rep").cast("string"), "ticker", F.col("i").cast("string")).cast("binary")))
    x = rows.select("ticker", "i", "r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return x.select(F.concat_ws("|", "ticker", F.col("rep").cast("string")).alias("ticker"), (F.row_number().over(order) - 1).cast("long").alias("i"), "r")


def shuffled(rows: DataFrame) -> DataFrame:
    """rows (ticker, i, r) with each ticker's returns in one other order."""
    return shuffles(rows, 1).withColumn("ticker", F.expr("substring(ticker, 1, length(ticker) - 2)"))
