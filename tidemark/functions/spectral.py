"""Welch's power spectral density of absolute returns, a batch of segments at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocked import in_blocks, scans

#: Values of a segment at most, and segments that one group transforms.
LONGEST, BATCH = 256, 64


def powers(parts: np.ndarray) -> np.ndarray:
    """Sums over segments (rows) of their one-sided densities: Hann window, constant detrend."""
    length = parts.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window)) ** 2 / (window**2).sum()
    power[:, 1 : (-1 if length % 2 == 0 else None)] *= 2
    return power.sum(0)


def psd(rows: DataFrame, least: int = 128) -> DataFrame:
    """rows (ticker, i, r): ticker, freq, psd of each series of more than ``least`` values.

    Segments overlap by half. A batch of them, some 8,000 values however long the series, is one
    Arrow group; densities are sums of the batches' sums.
    """
    x = scans(in_blocks(rows.select("ticker", "i", "r")), n=("n", "r")).where(F.col("n") > least)
    x = x.withColumn("length", F.least(F.lit(LONGEST), F.expr("cast(n div 2 as int)"))).withColumn("step", F.col("length") - F.expr("length div 2"))
    # a value is in the segments that begin at most a length before it
    last = F.floor((F.col("n") - F.col("length")) / F.col("step"))
    first = F.greatest(F.lit(0), F.floor((F.col("i") - F.col("length")) / F.col("step")) + 1)
    to = F.least(F.floor(F.col("i") / F.col("step")), last)
    x = x.select("ticker", "i", F.abs("r").alias("x"), "length", "step", first.alias("first"), to.alias("to")).where("first <= to")
    dealt = x.withColumn("batch", F.explode(F.sequence(F.floor(F.col("first") / BATCH), F.floor(F.col("to") / BATCH)))).drop("first", "to")

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        length, step, begin = int(pdf["length"].iloc[0]), int(pdf["step"].iloc[0]), int(pdf["batch"].iloc[0]) * BATCH
        values, offset = pdf["x"].to_numpy(float), int(pdf["i"].iloc[0]) - begin * step
        at = np.arange(BATCH) * step - offset
        at = at[(at >= 0) & (at + length <= len(values))]
        total = powers(values[at[:, None] + np.arange(length)])
        freq = np.arange(length // 2 + 1) / length  # rounded once: equal frequencies of different lengths are equal
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "freq": freq, "power": total, "k": len(at)})

    sums = dealt.groupBy("ticker", "batch").applyInPandas(one, "ticker string, freq double, power double, k long")
    return sums.groupBy("ticker", "freq").agg((F.sum("power") / F.sum("k")).alias("psd"))
