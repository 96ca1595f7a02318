"""Hourly bars from a stream of events, as Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.kept import shared_folder


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """ticker, ts, volume, high, low of each hour once the watermark has passed it. State is one row for each open hour and ticker."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = x.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("ticker")).agg(F.count(F.lit(1)).alias("volume"), F.max("value").alias("high"), F.min("value").alias("low"))
    return got.select("ticker", F.col("window.start").alias("ts"), "volume", "high", "low")


def replay(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The bars that a stream over the stored events emits, written by the stream as Parquet and read again."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    events = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads folders, the glob is for names of files
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = hourly(events).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    return spark.read.schema("ticker string, ts timestamp, volume long, high double, low double").parquet(f"{at}/out")
