"""The registry of queries: a Spark function and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def same_sql(name: str, text: str) -> None:
    """Registers one SQL text for both engines; tables are written {orders}."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLE_SQL[name] = text.format(**{n: n for n in names})


def slot_sql(expr: str) -> str:
    """DuckDB: the slot of an ASCII key."""
    h = f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(({expr})::VARCHAR, ''), lambda x: ascii(x)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616::HUGEINT)"
    return f"(CASE WHEN {h} >= 9223372036854775808::HUGEINT THEN (18446744073709551616::HUGEINT - {h}) % 1024 ELSE {h} % 1024 END)::INTEGER"


def shard_sql(expr: str) -> str:
    """DuckDB: the shard of an ASCII key in the even layout of 8 shards."""
    return f"({slot_sql(expr)} // 128)"
