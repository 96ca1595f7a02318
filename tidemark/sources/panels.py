"""Sources and sinks: tables in, long price panels (ticker, date, close) and hourly bars out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.blocked import in_blocks, numbered, scans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_prices(spark: SparkSession, path: str, start: str, end: str, tickers: list[str] | None = None, field: str = "close") -> DataFrame:
    """ticker, date, close of a bars table between two days, both included. ``end`` must be
    given, so that a rerun reads the same rows; a field is part of the request, never of a shared cache."""
    bars = spark.read.parquet(path).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(tickers))
    return bars.select("ticker", "date", F.col(field).alias("close"))


def save_bars(df: DataFrame, path: str) -> None:
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def finite(x: str | Column) -> Column:
    """Null for NaN and infinities."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def local_time(ts: str | Column, zone: str) -> Column:
    """The wall clock of a zone at an instant, without the zone: what bars of an exchange are dated by. An instant without a zone is taken as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (brand), date, close (mean unit price), volume."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("ticker", "date").agg(F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (nation), asset_class (region), date, close, volume."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date"))
    found = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = found.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return found.groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("asset_class"), "date").agg(F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def grid(bars: DataFrame) -> DataFrame:
    """ticker, date, i, close: every ticker on every day of the shared calendar, with the gaps that it has; i counts the days.

    The grid is the product of two dimensions, days and tickers, which is the result's own size.
    """
    days = numbered(bars.select("date").distinct(), "date", keys=())
    return days.crossJoin(bars.select("ticker").distinct()).join(bars.select("ticker", "date", "close"), ["ticker", "date"], "left").select("ticker", "date", "i", "close")


def _filled(bars: DataFrame) -> DataFrame:
    return scans(in_blocks(grid(bars)), close=("last", "close"))


def dense(bars: DataFrame) -> DataFrame:
    """Every ticker on every day of the shared calendar, close carried forward."""
    return _filled(bars).select("ticker", "date", "close")


def index_panel(bars: DataFrame) -> DataFrame:
    """ticker, date, i, close: an index for each ticker whose returns are its standardised prices over a hundred, from the day that all tickers have begun.

    The running sum of scores comes from that of prices; a ticker whose price never moves has none.
    """
    begun = bars.groupBy("ticker").agg(F.min("date").alias("first")).agg(F.max("first").alias("begun"))  # one row
    common = _filled(bars).join(F.broadcast(begun), F.col("date") >= F.col("begun")).where("close is not null")
    x = scans(common.select("ticker", "block", "date", "i", "close"), sum=("sum", "close"), k=("count", "close"), mean=("mean", "close"), std=("std", "close"))
    score = (F.col("sum") - F.col("k") * F.col("mean")) / F.nullif("std", F.lit(0.0))
    return x.select("ticker", "date", (F.col("k") - 1).alias("i"), (100 * F.exp(0.01 * score)).alias("close"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (event type), ts (hour), open, high, low, close, volume (events)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("hour"), F.struct("ts", "event_id").alias("at"), (F.col("value") + 1).alias("p"))
    return e.groupBy("ticker", F.col("hour").alias("ts")).agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def daily_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two daily series (date, close), of lines and of orders, whose calendars differ."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("close"))
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("close"))
    return lines, orders


def html_fields(pages: DataFrame, tag: str) -> DataFrame:
    """page_id, n, field: the texts between ``tag`` marks, in their order; a dot becomes a hyphen."""
    found = F.regexp_extract_all("html", F.lit(rf"<{tag}(?: [^<>]*)?>([^<>]*)</{tag}>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("n", "field")).select("page_id", F.col("n").cast("long"), F.translate(F.trim("field"), ".", "-").alias("field"))
