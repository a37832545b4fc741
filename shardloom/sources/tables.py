"""Reading the tables and writing results in the formats that Spark has."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shardloom-"))
        folder = sc.getCheckpointDir()
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one; the folder goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    return path


def round_trip(df: DataFrame, kind: str, path: str) -> DataFrame:
    """Writes in a format and reads back with the same schema."""
    writer, reader = df.write.mode("overwrite"), df.sparkSession.read.schema(df.schema)
    options = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"} if kind == "csv" else {}
    writer.format(kind).options(**options).save(path)
    return reader.format(kind).options(**options).load(path)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """A file of 'key value' lines parted by blanks; comments and empty lines are dropped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(parts[0].alias("name"), parts[1].alias("setting"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """JSON configuration files, one object each, by group."""
    return spark.read.option("multiLine", True).json(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A database's rows; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A database's table read by ranges of a number column, ``parts`` of them at a time.

    The bounds are asked for first; rows outside of them, which come meanwhile, and nulls are read too.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    ends = reader.load().agg(F.min(column), F.max(column)).first()
    if ends[0] is None or parts < 2:
        return reader.load()
    return reader.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(parts)).load()


def jdbc_shards(spark: SparkSession, urls: dict[str, str], query: str, **options: str) -> DataFrame:
    """The rows of the same query on several databases, with the shard's name each."""
    parts = [jdbc(spark, url, query, **options).withColumn("shard", F.lit(name)) for name, url in urls.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_json(df: DataFrame) -> DataFrame:
    """Rows as JSON messages, for a queue's sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("message"))


def log_line(*columns: str) -> Column:
    """A log line: the columns' texts with arrows between."""
    return F.concat_ws(" => ", *columns)



class ResultCache:
    """Small results kept for some seconds by the text that asks for them; when it is full all go."""

    def __init__(self, entries: int = 100, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}

    def get(self, text: str, build: Callable[[], DataFrame]) -> DataFrame:
        now, found = self.clock(), self.held.get(text)
        if found and now - found[0] < self.seconds:
            return found[1]
        if found:
            found[1].unpersist()
            del self.held[text]
        if len(self.held) >= self.entries:
            self.clear()
        df = build().cache()
        self.held[text] = (now, df)
        return df

    def clear(self) -> None:
        for _, df in self.held.values():
            df.unpersist()
        self.held = {}
