"""Execution schedules over hourly bars (ticker, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEDULES = ("uniform", "vwap_profile", "avoid_open", "front_load", "end_load")


def seasonality(bars: DataFrame) -> DataFrame:
    """ticker, hour, abs_ret, volume, n and both shapes over the plain mean of the hours."""
    r = F.ln("close") - F.lag(F.ln("close")).over(W.partitionBy("ticker").orderBy("ts"))
    by_hour = bars.withColumn("abs_ret", F.abs(r)).groupBy("ticker", F.hour("ts").alias("hour")).agg(F.avg("abs_ret").alias("abs_ret"), F.avg("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
    mean = W.partitionBy("ticker")
    return by_hour.withColumn("abs_ret_shape", F.try_divide("abs_ret", F.avg("abs_ret").over(mean))).withColumn("volume_shape", F.try_divide("volume", F.avg("volume").over(mean)))


def halves(bars: DataFrame, least: int = 200) -> DataFrame:
    """Adds half: 0 for the first half of a ticker's bars, which profiles are fitted on, else 1."""
    t = W.partitionBy("ticker")
    x = bars.withColumn("n_all", F.count(F.lit(1)).over(t)).where(F.col("n_all") >= least).withColumn("pos", F.row_number().over(t.orderBy("ts")))
    return x.withColumn("half", F.when(F.col("pos") <= F.expr("n_all div 2"), 0).otherwise(1)).drop("n_all", "pos")


def volume_profile(bars: DataFrame) -> DataFrame:
    """ticker, hour, share of the mean volumes."""
    mean = bars.groupBy("ticker", F.hour("ts").alias("hour")).agg(F.avg("volume").alias("v"))
    total = F.sum("v").over(W.partitionBy("ticker"))
    return mean.withColumn("total", total).where("total > 0").select("ticker", "hour", (F.col("v") / F.col("total")).alias("share"))


def day_vwap(bars: DataFrame) -> DataFrame:
    """ticker, date, vwap, n; the mean close of a day without volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    by_day = bars.groupBy("ticker", F.to_date("ts").alias("date"))
    return by_day.agg(F.when(F.sum("volume") > 0, F.sum(typical * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).otherwise(F.avg("close")).alias("vwap"), F.count(F.lit(1)).alias("n"))


def shortfall(bars: DataFrame, least: int = 4) -> DataFrame:
    """ticker, date and bps of each schedule's fill over the day's VWAP, in the second half, profiles from the first."""
    x = halves(bars)
    test = x.where("half = 1").withColumn("date", F.to_date("ts")).withColumn("hour", F.hour("ts"))
    day = W.partitionBy("ticker", "date")
    test = test.withColumn("n", F.count(F.lit(1)).over(day)).withColumn("rn", F.row_number().over(day.orderBy("ts"))).where(F.col("n") >= least)
    profile = volume_profile(x.where("half = 0"))
    test = test.join(profile, ["ticker", "hour"], "left").join(profile.select("ticker").distinct(), "ticker", "left_semi").withColumn("w", F.coalesce("share", 1.0 / F.col("n")))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    fills = test.groupBy("ticker", "date").agg(
        F.when(F.sum("volume") > 0, F.sum(typical * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).otherwise(F.avg("close")).alias("vwap"),
        F.avg("close").alias("uniform"),
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("close")), F.sum("w")), F.avg("close")).alias("vwap_profile"),
        F.avg(F.when(F.col("rn") > 1, F.col("close"))).alias("avoid_open"),
        F.min_by("close", "ts").alias("front_load"),
        F.max_by("close", "ts").alias("end_load"),
    )
    return fills.select("ticker", "date", *[(1e4 * (F.col(s) - F.col("vwap")) / F.col("vwap")).alias(s) for s in SCHEDULES])


def long_form(costs: DataFrame) -> DataFrame:
    return costs.unpivot(["ticker", "date"], list(SCHEDULES), "schedule", "bps")


def summary(costs: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("bps", F.lit(p))  # noqa: E731  exact, interpolated
    return long_form(costs).groupBy("schedule").agg(F.avg("bps").alias("mean"), q(0.5).alias("median"), F.stddev_samp("bps").alias("std"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.count("bps").alias("n"))


def paired_t(costs: DataFrame, a: str = "uniform") -> DataFrame:
    """schedule, mean_diff (``a`` less the schedule), t, n."""
    d = long_form(costs).join(costs.select("ticker", "date", F.col(a).alias("base")), ["ticker", "date"]).where(F.col("schedule") != a).withColumn("d", F.col("base") - F.col("bps"))
    return d.groupBy("schedule").agg(F.avg("d").alias("mean_diff"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t"), F.count("d").alias("n"))
