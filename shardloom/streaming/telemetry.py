"""Streaming twins of the windowed statistics: watermarked windows over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of a folder as a stream, with a timestamp that watermarks accept."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_samples(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """win, grp, total, n of closed windows; events later than the watermark are dropped."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("grp"))
    return grouped.agg(F.sum("value").alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("win"), "grp", "total", "n")


def sliding_rate(stream: DataFrame, width: str = "1 minute", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("win"), "n")


def first_sights(stream: DataFrame, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: what is always sampled."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there and reads back its output; ``folder`` must be shared by all executors."""
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
