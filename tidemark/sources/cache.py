"""A cache of prices that knows what it holds: intervals by (ticker, field), of which a request reads only the gaps.

A load takes requests (ticker, field, start, end), both days included. What of them no stored interval covers
is asked of the source, written under ``data``, and then entered in the catalogue by one file, whose rename is the
commit: a load that fails before it leaves nothing that a later one sees. Days without a
price are covered too, and aren't asked for again. A field is part of each entry, so that no field is ever taken for another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "ticker string, field string, start date, end date, part string"
ROW = "ticker string, field string, date date, value double"


def requests(spark: SparkSession, tickers: DataFrame, field: str, start: str, end: str) -> DataFrame:
    """One request for each row of ``tickers`` (ticker)."""
    return tickers.select("ticker").distinct().select("ticker", F.lit(field).alias("field"), F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end")).where("start <= end")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """All committed intervals; none where nothing is committed yet."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{root}/catalogue/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def gaps(asked: DataFrame, held: DataFrame) -> DataFrame:
    """ticker, field, start, end: the days of each request that no interval held covers, as intervals. Requests and intervals may overlap or repeat."""
    one = asked.distinct()
    had = held.select(F.col("ticker").alias("__t"), F.col("field").alias("__f"), F.col("start").alias("from"), F.col("end").alias("to"))
    met = one.join(had, (F.col("ticker") == F.col("__t")) & (F.col("field") == F.col("__f")) & (F.col("from") <= F.col("end")) & (F.col("to") >= F.col("start")), "left")
    keys = ("ticker", "field", "start", "end")
    before = W.partitionBy(*keys).orderBy("from", "to").rowsBetween(W.unboundedPreceding, -1)
    seen = met.select(*keys, "from", "to", F.coalesce(F.max("to").over(before), F.date_sub("start", 1)).alias("seen"))
    ahead = seen.select("ticker", "field", F.date_add("seen", 1).alias("a"), F.date_sub("from", 1).alias("b"))
    rest = met.groupBy(*keys).agg(F.max("to").alias("last")).select("ticker", "field", F.coalesce(F.date_add("last", 1), F.col("start")).alias("a"), F.col("end").alias("b"))
    found = ahead.unionByName(rest).where("a <= b")
    # gaps of requests that overlap are joined to one
    by = W.partitionBy("ticker", "field").orderBy("a", "b")
    new = F.coalesce(F.max("b").over(by.rowsBetween(W.unboundedPreceding, -1)) < F.date_sub("a", 1), F.lit(True))
    run = found.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("ticker", "field", "run").agg(F.min("a").alias("start"), F.max("b").alias("end")).drop("run")


def from_bars(bars: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A source that answers gaps from a table (ticker, date, ...) with a column for each field: it scans the fields and the span of days asked for, and no others."""

    def read(wanted: DataFrame) -> DataFrame:
        span = wanted.agg(F.collect_set("field").alias("fields"), F.min("start").alias("a"), F.max("end").alias("b")).first()
        days = bars.where(F.col("date").between(F.lit(span.a), F.lit(span.b)))
        long = days.select("ticker", "date", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in sorted(span.fields)])).alias("v")).select("ticker", "v.field", "date", "v.value")
        at = wanted.select(F.col("ticker").alias("__t"), F.col("field").alias("__f"), "start", "end")
        on = (F.col("ticker") == F.col("__t")) & (F.col("field") == F.col("__f")) & F.col("date").between(F.col("start"), F.col("end"))
        return long.join(at, on).where("value is not null").select("ticker", "field", "date", "value")

    return read


def load(spark: SparkSession, root: str, asked: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(ticker, field, date, value) of the requests, and the gaps that were read for them.

    Loads that run at once may both read a gap; a day that two parts hold counts once.
    """
    part = uuid.uuid4().hex
    gaps(asked, catalogue(spark, root)).withColumn("part", F.lit(part)).coalesce(1).write.parquet(f"{root}/gaps/{part}")
    missing = spark.read.schema(ENTRY).parquet(f"{root}/gaps/{part}")
    if not missing.isEmpty():
        read(missing.drop("part")).select("ticker", "field", "date", "value").write.parquet(f"{root}/data/{part}")
        missing.coalesce(1).write.parquet(f"{root}/catalogue/{part}")
    wanted = asked.distinct()
    there = catalogue(spark, root).alias("c").join(wanted.alias("w"), F.expr("c.ticker = w.ticker and c.field = w.field and c.start <= w.end and c.end >= w.start"))
    paths = [f"{root}/data/{r.part}" for r in there.select("c.part").distinct().collect()]  # one for each earlier load at most
    held = spark.read.schema(ROW).parquet(*paths) if paths else spark.createDataFrame([], ROW)
    within = F.expr("h.ticker = w.ticker and h.field = w.field and h.date between w.start and w.end")
    rows = held.alias("h").join(wanted.alias("w"), within, "left_semi")
    return rows.groupBy("ticker", "field", "date").agg(F.first("value").alias("value")), missing.drop("part")
