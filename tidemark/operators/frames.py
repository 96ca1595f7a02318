"""Row-wise windows over a long panel (ticker, date, ...), in blocks of rows, so that one long series is many tasks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.blocked import halo, in_blocks, inside, numbered, own, scans


def rolling(value: str | Column, first: int, last: int, of: Callable[[Column], Column]) -> Column:
    """``of`` over rows first..last from the current one, among rows with a halo; null unless all of them are there and have a value."""
    value = F.col(value) if isinstance(value, str) else value
    rows = inside().rowsBetween(first, last)
    return F.when(F.count(value).over(rows) == last - first + 1, of(value).over(rows))


def zscored(rows: DataFrame, value: str, out: str, n: int = 252) -> DataFrame:
    """Adds ``out`` to rows (ticker, i, ...): a value less the mean of the ``n`` up to it, by their standard deviation."""
    x = halo(rows.withColumn("__v", F.col(value)), before=n - 1)
    score = F.try_divide(F.col("__v") - rolling("__v", 1 - n, 0, F.avg), rolling("__v", 1 - n, 0, F.stddev_samp))
    return own(x.withColumn(out, score)).drop("__v")


def filled(rows: DataFrame, value: str, before: str, after: str) -> DataFrame:
    """Adds to rows (ticker, i, ...) the last value up to a row and the next one from it on."""
    return scans(in_blocks(rows), **{before: ("last", value), after: ("next", value)}).drop("block")


def _logged(prices: DataFrame, order: str = "date") -> DataFrame:
    """With lp, and numbered by i where that isn't known yet."""
    logged = prices.withColumn("lp", F.when(F.col("close") > 0, F.ln("close")))
    return logged if "i" in prices.columns else numbered(logged, order)


def with_returns(prices: DataFrame, order: str = "date") -> DataFrame:
    """Adds lp (log price), r (log return to the row before) and i (row number from 0)."""
    x = halo(_logged(prices, order), before=1)
    return own(x.withColumn("r", F.col("lp") - F.lag("lp").over(inside())))


def features(prices: DataFrame) -> DataFrame:
    """mom_12_1, ret_1m, vol_60, vol_252, target (next 21 rows) and fwd_vol_21 of each row, from one sort by ticker and block."""
    x = halo(_logged(prices), before=253, after=21).withColumn("r", F.col("lp") - F.lag("lp").over(inside()))
    back = lambda k: F.lag("lp", k).over(inside())
    year = F.sqrt(F.lit(252.0))
    made = x.select(
        "ticker", "date", "close", "lp", "r", "i", "block",
        ((F.col("lp") - back(252)) - (F.col("lp") - back(21))).alias("mom_12_1"),
        (F.col("lp") - back(21)).alias("ret_1m"),
        (rolling("r", -59, 0, F.stddev_samp) * year).alias("vol_60"),
        (rolling("r", -251, 0, F.stddev_samp) * year).alias("vol_252"),
        (F.lead("lp", 21).over(inside()) - F.col("lp")).alias("target"),
        (rolling("r", 1, 21, F.stddev_samp) * year).alias("fwd_vol_21"),
    )
    return own(made)


def percentile_rank(value: str, *keys: str) -> Column:
    """Average rank of ties over the count of values, within ``keys``."""
    return (F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0) / F.count(value).over(W.partitionBy(*keys))


def covered(prices: DataFrame, share: float) -> DataFrame:
    """Prices of tickers with a close on at least that share of all days, rounded down. (Over the whole sample, and so with hindsight.)"""
    days = prices.select("date").distinct().count()
    enough = prices.groupBy("ticker").agg(F.count("close").alias("n")).where(F.col("n") >= int(days * share))
    return prices.join(enough, "ticker", "left_semi")


def weekday_before(date: str | Column, k: int) -> Column:
    """The k-th Monday to Friday strictly before a day."""
    d = F.col(date) if isinstance(date, str) else date
    dow = F.weekday(d)  # Monday is 0
    start = F.when(dow >= 5, F.date_sub(d, dow - 5)).otherwise(d)  # the Saturday, for a weekend
    day = F.least(dow, F.lit(5))
    whole, rest = k // 5, k % 5
    back = 7 * whole + rest + F.when(day - rest < 0, 2).otherwise(0)
    return F.date_sub(start, back.cast("int"))


def align(key: str, value: str, **series: DataFrame) -> DataFrame:
    """One row for each key of any series, with a column for each series: null where it has none. Keys are unique
    within a series. However many they are, one union and one aggregation align them."""
    parts = [df.select(key, *[(F.col(value) if k == name else F.lit(None)).cast("double").alias(k) for k in series]) for name, df in series.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.max(k).alias(k) for k in series])
