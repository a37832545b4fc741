"""Merging per-shard results: the right answer over all shards, or the plain concatenation under the name "compat".

``frame`` has a column ``shard``. The global forms are ordinary Spark aggregates (partial by task, then final); the
compat forms keep each shard's own groups, order and offsets and append shards in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.sources.tables import work_folder

MONEY = "decimal(18,2)"
#: Aggregates that compat mode merges over shards; others are refused there.
MERGEABLE = {"count", "sum", "min", "max"}


def scatter_gather(frame: DataFrame, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """name -> (count, sum, min or max, column) per shard and then over shards: nulls skipped, all-null sums stay null."""
    if bad := {f for f, _ in aggregates.values()} - MERGEABLE:
        raise ValueError(f"not mergeable over shards: {sorted(bad)}")
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    last = first | {"count": F.sum}
    per = frame.groupBy("shard").agg(*(first[f](c).alias(n) for n, (f, c) in aggregates.items()))
    return per.agg(*((F.coalesce(last[f](n), F.lit(0)) if f == "count" else last[f](n)).alias(n) for n, (f, _) in aggregates.items()))


#: How a textual partial result is read for comparison; 12 + 18 digits hold what decimals of 20 integer digits need.
_READ = {
    "number": lambda c: F.col(c).try_cast("decimal(38,18)"),
    "date": lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d\d-\d\d$"), F.col(c).try_cast("date")),
    "datetime": lambda c: F.col(c).try_cast("timestamp_ntz"),
    "time": lambda c: F.concat(F.lit("1970-01-01 "), c).try_cast("timestamp_ntz"),
    "year": lambda c: F.col(c).try_cast("int"),
}


def merge_partials(partials: DataFrame, kinds: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """One row of texts from textual partial rows (one a shard): counts and sums added, min and max by value.

    ``types`` says which columns are date, datetime, time or year; others are numbers. The least or greatest value's
    own text is given, sums without trailing zeros; what can't be read counts as null.
    """
    types = types or {}

    def merged(column: str, kind: str) -> Column:
        value = _READ[types.get(column, "number")](column)
        if kind in ("count", "sum"):
            total = F.sum(value).cast("string")
            return F.when(total.contains("."), F.regexp_replace(total, r"\.?0+$", "")).otherwise(total)
        pick = F.min if kind == "min" else F.max
        return pick(F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(column).alias("t"))))["t"]

    return partials.agg(*(merged(c, k).alias(c) for c, k in kinds.items()))


def first_shard_value(column: str) -> Column:
    """What compat mode shows for a plain column beside aggregates: the first shard's, a null as the text null."""
    return F.coalesce(F.min_by(F.col(column).cast("string"), "shard"), F.lit("null"))


def number_rows(frame: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``frame`` with each row's place in the order, from 1, and no sort of all rows in one task.

    Rows are sorted by ranges into a table in the shared folder; a range's rows are counted, and a row's place is its
    place in its range behind those of the ranges before. Equal rows may change places.
    """
    spark, path = frame.sparkSession, work_folder(frame.sparkSession, "ordered")
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))  # one row for each range
    bases = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("base"))
    return rows.join(bases, "_part").withColumn(name, F.col("base") + F.col("_i") + 1).drop("_part", "_i", "base")


def grouped(frame: DataFrame, keys: list[str], *aggregates: Column, compat: bool = False) -> DataFrame:
    return frame.groupBy(*(["shard"] if compat else []), *keys).agg(*aggregates)


def distinct(frame: DataFrame, *columns: str, compat: bool = False) -> DataFrame:
    """Distinct rows; compat: distinct in each shard, shards appended."""
    return frame.select("shard", *columns).distinct().select(*columns) if compat else frame.select(*columns).distinct()


def top(frame: DataFrame, order: list[Column], n: int, offset: int = 0, compat: bool = False) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` in order; compat: each shard sorts, skips and cuts, and the first n of them in shard order stay."""
    if not compat:
        return frame.orderBy(*order).offset(offset).limit(n)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*order))
    ranked = frame.withColumn("_place", place).where((F.col("_place") > offset) & (F.col("_place") <= offset + n))
    return ranked.orderBy("shard", "_place").limit(n).drop("_place")


def concat_shards(frames: list[DataFrame]) -> DataFrame:
    """The shards' rows one after the other, all kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
