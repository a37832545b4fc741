"""Global ids: blocks of a sequence handed out to requests, zones, and the ids that a block gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.hashing import encode_composed


def allocate(requests: DataFrame, block: int, base: int = 0, seq: str = "seq", order: str = "req_no", count: str = "n") -> DataFrame:
    """seq, req_no, n, begin_id, end_id: requests of each sequence in order.

    A block holds ``block`` ids after its base. A request that doesn't fit drops the rest of its block and opens the
    next one; one larger than a block is refused (nulls). Where a block ends depends on all requests before, so each
    sequence's requests stream through one task in order, batch after batch, with two numbers kept between.
    """

    rows = requests.select(F.col(seq).alias("seq"), F.col(order).cast("long").alias("req_no"), F.col(count).cast("long").alias("n"))
    ordered = rows.repartition("seq").sortWithinPartitions("seq", "req_no")
    schema = "seq string, req_no long, n long, begin_id long, end_id long"

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition has whole sequences, sorted: state starts anew where the sequence changes
        state: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            for name, part in pdf.groupby("seq", sort=False, dropna=False):
                start, used = state.get(name, (base, 0))
                begin, end = [], []
                for n in part["n"]:
                    if n < 1 or n > block:
                        begin.append(None)
                        end.append(None)
                        continue
                    if used + n > block:
                        start, used = start + block, 0
                    begin.append(start + used + 1)
                    used += n
                    end.append(start + used)
                state = {name: (start, used)}
                yield part.assign(begin_id=pd.array(begin, "Int64"), end_id=pd.array(end, "Int64"))

    return ordered.mapInPandas(partition, schema)


def expand(ranges: DataFrame) -> DataFrame:
    """One row for each id of the ranges begin_id to end_id."""
    return ranges.where("begin_id is not null").withColumn("id", F.explode(F.sequence("begin_id", "end_id")))


def recycle(last: Column, pool: int | Column, least: int | Column, most: int | Column) -> Column:
    """The next block's base: back to the least seed when the block would pass the greatest."""
    least = least if isinstance(least, Column) else F.lit(least)
    return F.when(last + pool > most, least).otherwise(last + pool)


def active_zones(zones: DataFrame, idc: str) -> DataFrame:
    return zones.where(F.col("in_use") & (F.col("zone") == idc))


def composed_ids(seeds: Column, key_slot: Column) -> Column:
    return encode_composed(seeds, key_slot)


ALLOCATOR = "seq string, last long, pool long, least long, most long"


def start_allocator(rows: DataFrame, path: str) -> None:
    """Writes the first version of the table of sequences (ALLOCATOR)."""
    rows.select(*(c.split()[0] for c in ALLOCATOR.split(", "))).write.parquet(f"{path}/0")


def allocator(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(version, rows) of the table of sequences as the last refill left it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = [x.getPath() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    marked = [p for p in done if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    version = max(int(p.getName()) for p in marked)
    return version, spark.read.schema(ALLOCATOR).parquet(f"{path}/{version}")


def refill(spark: SparkSession, path: str, seq: str) -> int:
    """The base of the next block of a sequence, from 1 above which ``pool`` ids are the caller's.

    The table's next version is written before the block is used, and only if nobody wrote it meanwhile: a run that
    fails loses ids at most, and two callers never get the same block.
    """
    version, rows = allocator(spark, path)
    following = recycle(F.col("last"), F.col("pool"), F.col("least"), F.col("most"))
    rows.withColumn("last", F.when(F.col("seq") == seq, following).otherwise(F.col("last"))).write.mode("errorifexists").parquet(f"{path}/{version + 1}")
    found = spark.read.schema(ALLOCATOR).parquet(f"{path}/{version + 1}").where(F.col("seq") == seq).select("last").first()
    if found is None:
        raise ValueError(f"no sequence {seq}")
    return found[0]
