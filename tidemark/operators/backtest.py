"""Cross-sectional sort backtests as one plan over (month, ticker) rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.blocked import in_blocks, numbered, scans
from tidemark.operators.frames import percentile_rank
from tidemark.sources.kept import kept


@dataclass
class Backtest:
    """legs: date, ticker, leg (L or S), weight. returns: seq, date, long_r, short_r, ls_r, traded, turnover."""

    legs: DataFrame
    returns: DataFrame


def month_returns(daily: DataFrame) -> DataFrame:
    """ticker, date (month end), r: sums of daily log returns, for each ticker and each month from the panel's first to its last: 0.0 for a month without any.

    The grid is the product of two dimensions, months and tickers.
    """
    sums = daily.groupBy("ticker", F.last_day("date").alias("date")).agg(F.sum("r").alias("r"))
    span = sums.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    months = span.select(F.explode(F.expr("sequence(trunc(a, 'MM'), b, interval 1 month)")).alias("m")).select(F.last_day("m").alias("date"))
    grid = months.crossJoin(sums.select("ticker").distinct())
    return grid.join(sums, ["ticker", "date"], "left").select("ticker", "date", F.coalesce("r", F.lit(0.0)).alias("r"))


def month_factor(factor: DataFrame) -> DataFrame:
    """ticker, date (month end), factor: the last one of the month that isn't null."""
    return factor.where("factor is not null").groupBy("ticker", F.last_day("date").alias("date")).agg(F.max_by("factor", "date").alias("factor"))


def carried(factor: DataFrame, daily: DataFrame) -> DataFrame:
    """ticker, date (month end), factor: the last factor that a ticker has had by each month of the daily panel, from its first on: a month without one keeps that before.

    The grid is the product of two dimensions, months and tickers.
    """
    known = month_factor(factor)
    months = numbered(daily.select(F.last_day("date").alias("date")).distinct(), "date", keys=())
    grid = months.crossJoin(known.select("ticker").distinct()).join(known, ["ticker", "date"], "left")
    return scans(in_blocks(grid), factor=("last", "factor")).where("factor is not null").select("ticker", "date", "factor")


def signals(factor: DataFrame, daily: DataFrame) -> DataFrame:
    """ticker, date, r, factor of the month before. A month after the factor's last one doesn't trade."""
    monthly = month_factor(factor)
    shifted = monthly.select("ticker", F.last_day(F.add_months("date", 1)).alias("date"), "factor")
    traded = monthly.select("date").distinct()
    return month_returns(daily).join(shifted, ["ticker", "date"]).join(traded, "date", "left_semi")


def legs(signal: DataFrame, n_quantiles: int = 5, min_names: int = 5) -> DataFrame:
    """date, ticker, r, leg, weight of the months with names enough in all and in either leg."""
    ranked = signal.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("date"))).where(F.col("n") >= n_quantiles * min_names).withColumn("pct", percentile_rank("factor", "date"))
    leg = F.when(F.col("pct") > (n_quantiles - 1) / n_quantiles, "L").when(F.col("pct") <= 1 / n_quantiles, "S")
    sided = ranked.withColumn("leg", leg).where("leg is not null")
    month = W.partitionBy("date")
    sided = sided.withColumn("long_n", F.count_if(F.col("leg") == "L").over(month)).withColumn("short_n", F.count_if(F.col("leg") == "S").over(month))
    sided = sided.where((F.col("long_n") >= min_names) & (F.col("short_n") >= min_names))
    return sided.select("date", "ticker", "r", "leg", F.when(F.col("leg") == "L", 1.0 / F.col("long_n")).otherwise(-1.0 / F.col("short_n")).alias("weight"))


def _numbered(months: DataFrame) -> DataFrame:
    """Emitted months in order; a table of months is small, whatever the panel."""
    return months.withColumn("seq", F.row_number().over(W.orderBy("date")).cast("long"))


def sort_backtest(factor: DataFrame, daily: DataFrame, n_quantiles: int = 5, min_names: int = 5) -> Backtest:
    """factor (ticker, date, factor), daily (ticker, date, r). The signal of a month trades the next one.

    Skipped months emit no row, and the next turnover is against the last book held. The first
    book is free. traded is the sum of weight changes; turnover half of it over the gross book.
    """
    sided = kept(legs(signals(factor, daily), n_quantiles, min_names))  # of which months, books and changes are made
    months = _numbered(sided.groupBy("date").agg(F.avg(F.when(F.col("leg") == "L", F.col("r"))).alias("long_r"), F.avg(F.when(F.col("leg") == "S", F.col("r"))).alias("short_r"), F.sum(F.abs("weight")).alias("gross")))
    held = sided.join(months.select("date", "seq"), "date").select("seq", "ticker", "weight")
    # a weight enters in its month, and leaves in the next: changes are sums by (month, ticker)
    moves = held.unionByName(held.select((F.col("seq") + 1).alias("seq"), "ticker", (-F.col("weight")).alias("weight")))
    traded = moves.groupBy("seq", "ticker").agg(F.sum("weight").alias("d")).groupBy("seq").agg(F.sum(F.abs("d")).alias("traded")).where("seq > 1")
    out = months.join(traded, "seq", "left")
    return Backtest(sided.select("date", "ticker", "leg", "weight"), kept(out.select("seq", "date", "long_r", "short_r", (F.col("long_r") - F.col("short_r")).alias("ls_r"), "traded", (F.col("traded") / 2 / F.col("gross")).alias("turnover"))))


def net_returns(returns: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """Adds net_r: notional traded times cost; where only turnover is known, a gross book of 2 is taken."""
    traded = F.coalesce("traded", F.col("turnover") * 4, F.lit(0.0))
    return returns.withColumn("net_r", F.col("ls_r") - traded * cost_bps / 1e4)


def equity(returns: DataFrame, value: str = "ls_r") -> DataFrame:
    """seq, date, equity, drawdown against the running maximum. One row for each month."""
    run = W.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return returns.select("seq", "date", F.product(1 + F.col(value)).over(run).alias("equity")).withColumn("drawdown", F.col("equity") / F.max("equity").over(run) - 1)


def stats(returns: DataFrame, value: str = "ls_r", cost_bps: float = 0.0) -> DataFrame:
    """One row, or none for fewer than two months."""
    curve = equity(returns.where(F.col(value).isNotNull()), value).select("seq", "drawdown")
    x = returns.where(F.col(value).isNotNull()).join(curve, "seq")
    vol = F.stddev_samp(value) * F.sqrt(F.lit(12.0))
    return x.agg(
        (F.avg(value) * 12).alias("ann_return"), vol.alias("ann_vol"), F.try_divide(F.avg(value) * 12, vol).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n_periods"), F.avg("turnover").alias("turnover"), F.lit(float(cost_bps)).alias("cost_bps_per_side"),
    ).where("n_periods >= 2")


def composition(sided: DataFrame, key: Column | str) -> DataFrame:
    """leg, key, n and share of the leg."""
    counted = sided.groupBy("leg", (F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("leg")))


def residualize(panel: DataFrame, least: int = 20) -> DataFrame:
    """panel (date, ticker, cls, h, vol): adds residual of h on class dummies and vol, by day.

    By Frisch-Waugh-Lovell: h and vol less their class means, then one slope for each day. Classes with one name, and days with
    fewer than ``least`` names, before or after, have none.
    """
    day, group = W.partitionBy("date"), W.partitionBy("date", "cls")
    x = panel.where("h is not null and vol is not null and cls is not null")
    x = x.withColumn("n", F.count(F.lit(1)).over(day)).where(F.col("n") >= least).withColumn("k", F.count(F.lit(1)).over(group)).where("k >= 2")
    x = x.withColumn("n", F.count(F.lit(1)).over(day)).where(F.col("n") >= least)
    x = x.withColumn("hd", F.col("h") - F.avg("h").over(group)).withColumn("vd", F.col("vol") - F.avg("vol").over(group))
    slope = F.try_divide(F.sum(F.col("hd") * F.col("vd")).over(day), F.sum(F.col("vd") * F.col("vd")).over(day))
    return x.select("date", "ticker", "cls", "h", "vol", (F.col("hd") - F.coalesce(slope, F.lit(0.0)) * F.col("vd")).alias("residual"))


def report_lines(bt: Backtest, cost_bps: float = 10.0) -> DataFrame:
    """seq, line: gross, then net, each from one row of statistics; a line says so where there are none."""
    out = []
    for k, (name, c) in enumerate((("gross", 0.0), ("net", cost_bps))):
        x = stats(net_returns(bt.returns, c), "net_r", c)
        line = F.format_string(f"{name}: return %+.2f%% vol %.2f%% sharpe %.2f drawdown %.2f%% months %d", F.col("ann_return") * 100, F.col("ann_vol") * 100, F.coalesce("sharpe", F.lit(0.0)), F.col("max_drawdown") * 100, F.col("n_periods"))
        out.append(x.agg(F.coalesce(F.max(line), F.lit(f"{name}: no returns")).alias("line")).select(F.lit(k).cast("long").alias("seq"), "line"))
    return out[0].unionByName(out[1])


def report(bt: Backtest, title: str, cost_bps: float = 10.0) -> str:
    """A few lines of text."""
    return "\n".join([title, *(r.line for r in report_lines(bt, cost_bps).orderBy("seq").collect())])
