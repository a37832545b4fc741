"""Writes to sharded tables as partitioned writes, their checks, and the consistency of two dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardloom.functions.hashing import decode_composed
from shardloom.operators.catalog import ShardError, Table
from shardloom.operators.routing import read_sharded, with_shard, write_sharded
from shardloom.sources.tables import work_folder


def insert(df: DataFrame, table: Table, path: str, dim: int = 0, single: bool = False) -> None:
    """Appends rows to their shards; ``single``: all rows must belong to one slot, as a plain multi-row INSERT's must."""
    if single and with_shard(df, table, dim).select("slot").distinct().limit(2).count() > 1:
        raise ShardError("ERR_SQL_SYNTAX_ERROR", "the rows belong to several shards")
    write_sharded(df, table, path, dim, mode="append")


def hash_check(df: DataFrame, composed: str, key_slot: Column) -> DataFrame:
    """Rows whose id doesn't embed the slot of their key."""
    return df.withColumn("id_slot", decode_composed(F.col(composed))).withColumn("key_slot", key_slot).where("id_slot <> key_slot")


def upsert_mapping(mapping: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The mapping after the changes: for each key its last change, else what it had."""
    last = changes.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in mapping.columns if c != key))
    return mapping.join(last, key, "left_anti").unionByName(last.select(*mapping.columns))


def update(spark: SparkSession, path: str, shards: list[int], where: Column | None, changes: dict[str, Column]) -> DataFrame:
    """The rows of the touched shards with the changes; ``update_rows`` writes them back."""
    if where is None:
        raise ShardError("ERR_SQL_SYNTAX_ERROR", "UPDATE without WHERE")
    df = read_sharded(spark, path, shards)
    return df.select(*(F.when(where, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))


def delete(spark: SparkSession, path: str, shards: list[int], where: Column | None) -> DataFrame:
    """The rows of the touched shards that stay; ``delete_rows`` writes them back."""
    if where is None:
        raise ShardError("ERR_SQL_SYNTAX_ERROR", "DELETE without WHERE")
    return read_sharded(spark, path, shards).where(~F.coalesce(where, F.lit(False)))


def replace_shards(df: DataFrame, path: str, shards: list[int]) -> None:
    """Puts ``df`` in the place of the rows of some shards; those that it has no rows of are emptied.

    ``df`` may read the same folder: it is written as a draft first.
    """
    spark, draft = df.sparkSession, work_folder(df.sparkSession, "draft")
    df.write.parquet(draft)
    rows = spark.read.schema(df.schema).parquet(draft)
    held = {r.shard for r in rows.select("shard").distinct().collect()}  # one row for each shard at most
    if extra := held - set(shards):
        raise ShardError("ERR_SQL_SYNTAX_ERROR", f"rows of other shards: {sorted(extra)[:5]}")
    if held:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    empty_shards(spark, path, sorted(set(shards) - held), rows.drop("shard").schema)


def empty_shards(spark: SparkSession, path: str, shards: list[int], schema: StructType | None = None) -> None:
    """Leaves no rows in some shards; a file without rows keeps the schema, even where all shards are emptied."""
    schema = schema or spark.read.parquet(path).drop("shard").schema
    for s in shards:
        spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/shard={s}")


def _counts(spark: SparkSession, path: str, shards: list[int], where: Column) -> DataFrame:
    """shard, affected, warnings: how many rows of each shard a condition holds for, counted before a write."""
    found = read_sharded(spark, path, shards).where(where).groupBy("shard").agg(F.count("*").alias("affected"))
    return spark.createDataFrame([(r.shard, r.affected, 0) for r in found.collect()], "shard int, affected long, warnings long")  # one row for each shard


def update_rows(spark: SparkSession, path: str, shards: list[int], where: Column | None, changes: dict[str, Column]) -> DataFrame:
    """UPDATE: changes the rows of the touched shards in place; gives each shard's affected rows."""
    rows = update(spark, path, shards, where, changes)
    counts = _counts(spark, path, shards, where)
    replace_shards(rows, path, shards)
    return counts


def delete_rows(spark: SparkSession, path: str, shards: list[int], where: Column | None) -> DataFrame:
    """DELETE: removes rows of the touched shards; gives each shard's affected rows."""
    rows = delete(spark, path, shards, where)
    counts = _counts(spark, path, shards, where)
    replace_shards(rows, path, shards)
    return counts


def delete_keys(spark: SparkSession, path: str, table: Table, keys: DataFrame, dim: int = 0) -> None:
    """Batch DELETE: removes the rows with the keys of a table of keys, in the shards that these belong to."""
    column = table.dimensions[dim].columns[0]
    placed = with_shard(keys.select(column).where(F.col(column).isNotNull()).distinct(), table, dim)
    shards = [r.shard for r in placed.select("shard").distinct().collect()]  # as many as shards at most
    if shards:
        replace_shards(read_sharded(spark, path, shards).join(placed.select(column), column, "left_anti").select(*spark.read.parquet(path).columns), path, shards)


def truncate(spark: SparkSession, path: str, table: Table, shards: list[int] | None = None, dim: int = 0) -> list[int]:
    """TRUNCATE of all shards or of those listed, one after the other; returns what was emptied."""
    count = len(table.dimensions[dim].tables)
    wanted = list(range(count)) if shards is None else sorted(set(shards))
    if bad := [s for s in wanted if not 0 <= s < count]:
        raise ShardError("ERR_SQL_SYNTAX_ERROR", f"no such shards: {bad[:5]}")
    empty_shards(spark, path, wanted)
    return wanted


def watched_columns(table: Table, changes: list[str]) -> list[str]:
    """The changed columns of an UPDATE that its rows' shards or ids hang on: such a change doesn't move the rows."""
    keys = {c for d in table.dimensions for c in d.columns} | set(table.composed)
    return sorted(keys & set(changes))


def rebalance_filter(where: Column, created: str, since: str) -> Column:
    """A condition held to rows created after a time."""
    return (F.col(created) > F.lit(since).cast("timestamp_ntz")) & where


def compare_dimensions(one: DataFrame, two: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows that two dimensions of a table don't have alike: missing in one, or with other values."""
    a = one.select(key, F.xxhash64(*values).alias("_a"))
    b = two.select(key, F.xxhash64(*values).alias("_b"))
    joined = a.join(b, key, "full_outer")
    state = F.when(F.col("_a").isNull(), "missing_in_first").when(F.col("_b").isNull(), "missing_in_second").when(F.col("_a") != F.col("_b"), "different")
    return joined.select(key, state.alias("state")).where("state is not null")


def affected(results: DataFrame) -> DataFrame:
    """The sum of the shards' affected rows and warnings."""
    return results.agg(F.sum("affected").alias("affected"), F.sum("warnings").alias("warnings"))


def spanning_transactions(statements: DataFrame, tx: str = "tx", slot: str = "slot") -> DataFrame:
    """Transactions that touch more than one slot."""
    return statements.where(F.col(slot).isNotNull()).groupBy(tx).agg(F.count_distinct(slot).alias("slots")).where("slots > 1")


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """For each key its last row."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
