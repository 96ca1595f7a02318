"""Regime gates and the audits of estimators: persistence, dispersion, sub-periods, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import fractal, synthetic
from tidemark.functions.blocked import numbered
from tidemark.functions.ordered import expanding_median
from tidemark.sources.kept import kept


def gate(rows: DataFrame, causal: bool = True, warm_up: int = 40) -> DataFrame:
    """rows (date, delta_h, fwd): gated is fwd where delta_h is at most the threshold, else 0.

    The causal threshold is the median of the rows before, and the first ``warm_up`` rows are in; the leaky
    one is the median of all rows, kept to show what hindsight earns. Rows of one series, each with a delta_h and a date of its own.
    """
    x = kept(numbered(rows, "date", keys=()))
    if causal:
        x = expanding_median(x, "delta_h", "threshold")
        inside = (F.col("i") < warm_up) | (F.col("delta_h") <= F.col("threshold"))
    else:
        x = x.crossJoin(F.broadcast(x.agg(F.percentile("delta_h", F.lit(0.5)).alias("threshold"))))  # one row
        inside = F.col("delta_h") <= F.col("threshold")
    return x.select("date", "delta_h", "fwd", "threshold", F.when(inside, F.col("fwd")).otherwise(0.0).alias("gated"))


def rank_persistence(factor: DataFrame, lags: tuple[int, ...], least: int = 20) -> DataFrame:
    """factor (idx, ticker, h), idx counting rebalances: lag, mean Spearman correlation, pairs. Lag pairs meet in an equi-join."""
    x = factor.where("h is not null")
    a = x.select("idx", "ticker", F.col("h").alias("a"), F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("to", F.col("idx") + F.col("lag"))
    both = a.join(x.select(F.col("idx").alias("to"), "ticker", F.col("h").alias("b")), ["to", "ticker"])
    keys = ("lag", "idx")

    def rank(v):
        return F.rank().over(W.partitionBy(*keys).orderBy(v)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, v)) - 1) / 2.0

    ranked = both.select(*keys, rank("a").alias("ra"), rank("b").alias("rb"))
    each = ranked.groupBy(*keys).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return each.groupBy("lag").agg(F.avg("rho").alias("rho"), F.count("rho").alias("pairs"))


def dispersion(factor: DataFrame) -> DataFrame:
    """One row: the mean over rebalances of the cross-sectional standard deviation, and their number."""
    return factor.groupBy("idx").agg(F.stddev_samp("h").alias("s")).agg(F.avg("s").alias("mean_std"), F.count("s").alias("n"))


def implied_dispersion(observed: DataFrame, noise: DataFrame) -> DataFrame:
    """observed, noise, implied from one row with mean_std and one with noise; implied is 0 where the noise is larger."""
    left = F.col("mean_std") * F.col("mean_std") - F.col("noise") * F.col("noise")
    return observed.crossJoin(noise).select(F.col("mean_std").alias("observed"), "noise", F.sqrt(F.greatest(left, F.lit(0.0))).alias("implied"))


def breaches(rolling: DataFrame, noise: DataFrame) -> DataFrame:
    """rolling (ticker, h), noise one row: for each ticker its windows, mean and standard deviation of h, and how many are
    further from a half than 1.96 times the noise."""
    out = F.abs(F.col("h") - 0.5) > 1.96 * F.col("noise")
    x = rolling.where("h is not null").crossJoin(F.broadcast(noise)).groupBy("ticker")
    return x.agg(F.count(F.lit(1)).alias("windows"), F.avg("h").alias("mean"), F.stddev_samp("h").alias("std"), F.first("noise").alias("noise"), F.count_if(out).alias("breaches"), F.avg(out.cast("double")).alias("share"))


def subperiods(panel: DataFrame, edges: list[tuple[str, str, str]]) -> DataFrame:
    """panel (ticker, date, r) rows once for each period (name, first day, last day, both included) they are in; ticker becomes ticker|name."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in edges])
    x = panel.withColumn("p", F.explode(named)).where(F.col("date").between(F.col("p.a"), F.col("p.b")))
    return x.select(F.concat_ws("|", "ticker", "p.name").alias("ticker"), "date", "r")


def coverage(prices: DataFrame, era: str) -> DataFrame:
    """ticker, first, last, n and whether the first day is by ``era``."""
    x = prices.where("close is not null").groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))
    return x.withColumn("covered", F.col("first") <= F.lit(era).cast("date"))


def subperiod_significance(panel: DataFrame, edges: list[tuple[str, str, str]], seeds: int = 50, least: int = 300) -> DataFrame:
    """ticker (as ticker|name), n, h, noise, significant for each period with ``least`` returns or more.

    noise is the standard deviation of h over ``seeds`` series of white noise of the same length, one
    set for each length that occurs; h is significant if further than 1.96 times that from a half.
    """
    x = fractal.series(subperiods(panel, edges)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ticker"))).where(F.col("n") >= least)
    lengths = x.select("ticker", "n").distinct()
    made = lengths.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).select("n", "seed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    named = kept(made.select(F.concat_ws("|", F.col("n").cast("string"), F.col("seed").cast("string")).alias("ticker"), "i", synthetic.normal("n", "seed", "i").alias("r")))  # lest Spark takes it to be as small as the lengths
    noise = fractal.dfa(named).groupBy(F.substring_index("ticker", "|", 1).cast("long").alias("n")).agg(F.stddev_pop("h").alias("noise"))
    got = fractal.dfa(x.select("ticker", "i", "r")).join(lengths, "ticker").join(noise, "n")
    return got.select("ticker", "n", "h", "noise", (F.abs(F.col("h") - 0.5) > 1.96 * F.col("noise")).alias("significant"))


def validation(known: DataFrame, noise: DataFrame, short: DataFrame) -> DataFrame:
    """series, estimator, n, mean, std, min, max, rejections: what estimators make of fractional noise of ``known`` memory
    (n, true_h, seed, i, r), of white ``noise`` and of ``short`` memory (series_id, i, r)."""
    def summary(x: DataFrame, name, estimator: str, value: str, rejected=None) -> DataFrame:
        many = F.sum(rejected.cast("long")) if rejected is not None else F.lit(None).cast("long")
        stats = [f(value).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
        return x.groupBy(name.alias("series")).agg(F.lit(estimator).alias("estimator"), F.count(value).alias("n"), *stats, many.alias("rejections"))

    named = known.select(F.concat_ws("|", F.col("true_h").cast("string"), F.col("seed").cast("string")).alias("ticker"), "i", "r")
    parts = [summary(fractal.dfa(named), F.concat(F.lit("fractional noise "), F.substring_index("ticker", "|", 1)), "dfa", "h")]
    for name, rows in (("white noise", noise), ("short memory", short)):
        x = rows.select(F.col("series_id").cast("string").alias("ticker"), "i", "r")
        for estimator, q in (("modified range", None), ("classical range", 0)):
            parts.append(summary(fractal.modified_rs(x, q), F.lit(name), estimator, "h_implied", F.col("rejects_null_95")))
    return reduce(DataFrame.unionByName, parts)
