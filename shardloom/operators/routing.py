"""Reading and writing sharded tables: a table is one Parquet folder with a partition for each shard.

Routing turns key values into shard numbers on the driver (a few literals) or in a join (a table of keys); Spark then
prunes partitions. Which predicate routes is a fixed order of preference, kept as small functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shardloom.functions.hashing import SLOTS, slot, slot_of_integer, slot_of_keys
from shardloom.operators.catalog import CATALOG, ShardError, Table

#: From so many values on, an IN list is joined as a table.
LONG_LIST = 100


def java_hash(text: str) -> int:
    """The wrapping 64-bit hash of a literal on the driver."""
    raw, h = text.encode("utf-16-be"), 0
    for i in range(0, len(raw), 2):
        h = (h * 31 + (raw[i] << 8 | raw[i + 1])) % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def slot_of(value: object) -> int:
    """The slot of one literal; -1 for None."""
    return -1 if value is None else abs(java_hash(str(value))) % SLOTS


def two_dim_slots(value: object) -> tuple[int, int]:
    """Both slots of a two-dimensional id's literal; -1 where its last five characters aren't hexadecimal digits."""
    tail = str(value)[-5:]
    if len(tail) < 5 or any(c not in "0123456789abcdefABCDEF" for c in tail):
        return -1, -1
    return int(tail, 16) >> 10, int(tail, 16) & (SLOTS - 1)


def slot_of_all(values: tuple) -> int:
    """The slot of the literals of several key columns: of their wrapped product, or of a text's slot in its place."""
    if len(values) == 1:
        return slot_of(values[0])
    product = 1
    for v in values:
        text = str(v)
        n = int(text) if v is not None and re.fullmatch(r"[+-]?[0-9]+", text) and -(1 << 63) <= int(text) < 1 << 63 else slot_of(v)
        product = (product * n + (1 << 63)) % (1 << 64) - (1 << 63)
    return slot_of(product if product == -(1 << 63) else abs(product))


def with_shard(df: DataFrame, table: Table, dim: int = 0) -> DataFrame:
    """``df`` with slot and shard of one dimension; keys may be of any type and length, rows without a key get no shard."""
    d = table.dimensions[dim]
    keys = [F.col(c) for c in d.columns]
    one = slot_of_integer if isinstance(df.select(keys[0]).schema[0].dataType, IntegralType) else slot
    s = slot_of_keys(*keys) if len(keys) > 1 else one(keys[0])
    return df.withColumn("slot", s).withColumn("shard", d.shard_column(F.col("slot")))


def write_sharded(df: DataFrame, table: Table, path: str, dim: int = 0, mode: str = "overwrite") -> None:
    """Rows to their shards' partitions; one shuffle by shard and a salt keeps files few and hot shards on many tasks.

    Rows without a key go to the null shard's partition, which only reads of all shards see.
    """
    rows = with_shard(df, table, dim).drop("slot")
    salt = F.pmod(F.xxhash64(*table.dimensions[dim].columns), F.lit(8))
    rows.repartition("shard", salt).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def read_sharded(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """All shards, or those listed: a filter on the partition column, so that other shards aren't listed or read."""
    df = spark.read.parquet(path)
    return df if shards is None else df.where(F.col("shard").isin(sorted(set(shards))))


def choose_route(table: Table, equal: dict[str, list], mapping_costs: bool = True, strict: bool = False, shard_index: int | None = None) -> tuple[str, list]:
    """(kind, values): index, composed, key, mapping or all, in this order of preference; strict (writes) doesn't fan out.

    ``equal`` has the literals of equality and IN predicates that hold for the whole condition (not those below an OR).
    """
    if shard_index is not None:
        return "index", [shard_index]
    if found := next((c for c in table.composed if c in equal), None):
        return "composed", equal[found]
    dims = table.dimensions
    keys = [d for d in dims if all(c in equal for c in d.columns)]
    if (len(keys) == len(dims)) if strict else keys:
        return "key", list(zip(*(equal[c] for c in keys[0].columns), strict=True)) if len(keys[0].columns) > 1 else equal[keys[0].columns[0]]
    if found := next((c for c in table.mapping if c in equal), None):
        if strict or not mapping_costs or len(equal[found]) < len(dims[0].tables):
            return "mapping", equal[found]
    if strict:
        raise ShardError("ERR_KEY_IS_NOT_COMPOSED" if keys else "ERR_NO_COMPOSED_ID", f"no key of {table.name} routes this write")
    return "all", []


def shards_of(table: Table, kind: str, values: list, dim: int = 0) -> list[int]:
    """Shard indexes for a route found by ``choose_route``; mapping routes need a lookup first."""
    d = table.dimensions[dim]
    if kind == "all":
        return list(range(len(d.tables)))
    if kind == "index":
        return list(values)
    slots = [_slot(table, kind == "composed", v, dim) for v in values]
    if kind == "composed" and -1 in slots:
        raise ShardError("ERR_NO_COMPOSED_ID", f"not an id of {table.name}")
    return sorted({d.shard_of(s) for s in slots if s >= 0})


def _slot(table: Table, composed: bool, value: object, dim: int) -> int:
    """The slot of a routing literal: what its id embeds, or what its key hashes to (a tuple for several columns)."""
    if composed and table.decoder == "composed":
        return int(value) & (SLOTS - 1) if re.fullmatch(r"[+-]?[0-9]+", str(value)) else -1
    if composed and table.decoder == "two_dim":
        return two_dim_slots(value)[dim]
    return slot_of_all(value) if isinstance(value, tuple) else slot_of(value)


def single_shard(table: Table, kind: str, values: list) -> int:
    """The only shard that a write may touch."""
    found = shards_of(table, kind, values)
    if len(found) != 1:
        raise ShardError("ERR_SQL_SYNTAX_ERROR", f"the values belong to {len(found)} shards")
    return found[0]


def by_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in a table of keys: what a long IN list becomes."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def mapping_lookup(fact: DataFrame, mapping: DataFrame, keys: Column, value: str) -> DataFrame:
    """Rows of ``fact`` found by a mapping table: its rows where ``keys`` holds give the sharding key (one for each key)."""
    wanted = mapping.where(keys).select(value).distinct()
    return fact.join(wanted, value, "left_semi")


def shard_info(spark: SparkSession, table: str, column: str, values: list, tables: dict[str, Table] = CATALOG) -> DataFrame:
    """Where each of some key values lives: value, slot, shard, physical table, database."""
    t = tables[table]
    d = next((d for d in t.dimensions if d.columns == [column]), t.dimensions[0])
    rows = [(str(v), s := _slot(t, column in t.composed, v, t.dimensions.index(d)), d.shard_of(s), *d.slots[s]) for v in values]
    return spark.createDataFrame(rows, "value string, slot int, shard int, physical_table string, database string")


def role_of(kind: str, in_transaction: bool = False, force_master: bool = False) -> str:
    """Writes, transactions and forced statements go to the master, other reads to a replica."""
    return "master" if force_master or in_transaction or kind != "SELECT" else "slave"


