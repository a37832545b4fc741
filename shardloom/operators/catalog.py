"""The sharding catalog: which slots belong to which table and database, from configuration texts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.hashing import SLOTS


class ShardError(ValueError):
    """An error with the code that callers know it by."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def expand_tables(template: str) -> list[str]:
    """The tables of 'prefix_[0-3,7,9-15-2]suffix': numbers, ranges, and ranges with a step."""
    m = re.fullmatch(r"([^\[\]]*)\[([^\[\]]+)\]([^\[\]]*)", template.strip())
    if not m:
        return [template.strip()]
    out = []
    for part in m[2].split(","):
        numbers = [int(x) for x in part.split("-")]
        out += range(numbers[0], numbers[1 if len(numbers) > 1 else 0] + 1, numbers[2] if len(numbers) > 2 else 1)
    return [f"{m[1]}{i}{m[3]}" for i in out]


def expand_slots(ranges: str) -> list[int]:
    """The slots of '0-1,2-4,8'."""
    return [s for part in ranges.split(",") for s in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1)]


@dataclass
class Dimension:
    """One sharding dimension of a table: its key columns and, by slot, the table and database."""

    columns: list[str]
    slots: dict[int, tuple[str, str]]
    hash_range: int = SLOTS

    @classmethod
    def of(cls, columns: str, hash_slots: dict[str, str], routes: dict[str, str], hash_range: int = SLOTS) -> Dimension:
        """From slot ranges by table and databases by table template; the last of several wins."""
        database = {t: db for template, db in routes.items() for t in expand_tables(template)}
        table = {s: t for t, ranges in hash_slots.items() for s in expand_slots(ranges)}
        missing = [s for s in range(hash_range) if s not in table]
        if missing:
            raise ShardError("ERR_KEY_CANNOT_FOUND_IN_CFG", f"slots without a table: {missing[:5]}")
        if unplaced := sorted({t for t in table.values() if t not in database}):
            raise ShardError("ERR_KEY_CANNOT_FOUND_IN_CFG", f"tables without a database: {unplaced[:5]}")
        if unused := sorted(set(database) - set(table.values())):
            raise ShardError("ERR_KEY_CANNOT_FOUND_IN_CFG", f"tables without slots: {unused[:5]}")
        return cls([c.strip() for c in columns.split(",")], {s: (t, database[t]) for s, t in table.items()}, hash_range)

    @property
    def tables(self) -> list[str]:
        """Shards in natural order: their places are their indexes."""
        return sorted({t for t, _ in self.slots.values()}, key=natural)

    @property
    def prefix(self) -> str:
        return commonprefix(self.tables)

    def shard_of(self, slot: int) -> int:
        return self.tables.index(self.slots[slot][0])

    def shard_column(self, slot: Column) -> Column:
        """The shard's index of a slot, null for -1: a division for even ranges, else a table of 1024 entries at most in the plan.

        The slot, which is a long expression, is written once.
        """
        index = {t: i for i, t in enumerate(self.tables)}
        step = self.hash_range // len(index)
        if all(index[self.slots[s][0]] == s // step for s in range(self.hash_range)):
            return F.get(F.array(*(F.lit(i) for i in range(len(index)))), F.floor(slot / step).cast("int"))
        return F.get(F.array(*(F.lit(index[self.slots[s][0]]) for s in range(self.hash_range))), slot)


def natural(text: str) -> list:
    """A key that compares digit runs by value, ties by the text."""
    return [[(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", text)], text]


@dataclass
class Table:
    """A logical table: its dimensions, the composed id's columns and decoder, and mapping keys to the sharding key."""

    name: str
    dimensions: list[Dimension]
    composed: list[str] = field(default_factory=list)
    decoder: str = "composed"  # or "hash": the id itself is hashed; "two_dim": hexadecimal tail
    mapping: list[str] = field(default_factory=list)


def catalog_of(config: dict) -> dict[str, Table]:
    """The tables of a configuration: {"tables": [{"name", "composed", "decoder", "mapping", "dimensions": [...]}]}.

    A dimension has "columns" ("a" or "a,b"), "slots" (table: ranges), "databases" (table template: database) and,
    if it isn't 1024, "hash_range"; texts with commas may be lists.
    """
    listed = lambda x: [p.strip() for p in x.split(",") if p.strip()] if isinstance(x, str) else list(x or [])
    out = {}
    for t in config.get("tables", []):
        dims = [Dimension.of(",".join(listed(d["columns"])), d["slots"], d["databases"], d.get("hash_range", SLOTS)) for d in t["dimensions"]]
        decoder = t.get("decoder", "composed")
        if decoder not in ("composed", "hash", "two_dim"):
            raise ShardError("ERR_KEY_CANNOT_FOUND_IN_CFG", f"unknown decoder {decoder}")
        if t["name"] in out:
            raise ShardError("ERR_KEY_CANNOT_FOUND_IN_CFG", f"table {t['name']} twice")
        out[t["name"]] = Table(t["name"], dims, listed(t.get("composed")), decoder, listed(t.get("mapping")))
    return out


def load_catalog(spark: SparkSession, path: str) -> dict[str, Table]:
    """The catalog of JSON configuration files, or of YAML ones (several documents) where a YAML reader is installed."""
    tables: dict[str, Table] = {}
    for name, text in sorted(map(tuple, spark.read.text(path, wholetext=True).select("_metadata.file_path", "value").collect())):  # configuration files
        if name.endswith((".yml", ".yaml")):
            import yaml

            parts = list(yaml.safe_load_all(text))
        else:
            parts = [json.loads(text)]
        for part in parts:
            found = catalog_of(part or {})
            if twice := sorted(set(found) & set(tables)):
                raise ShardError("ERR_KEY_CANNOT_FOUND_IN_CFG", f"tables in several files: {twice[:5]}")
            tables |= found
    return tables


def config_of(tables: dict[str, Table]) -> dict:
    """The configuration that ``catalog_of`` reads back to these tables."""

    def dimension(d: Dimension) -> dict:
        slots: dict[str, list[int]] = {}
        for s, (t, _) in sorted(d.slots.items()):
            slots.setdefault(t, []).append(s)
        ranges = {t: ",".join(f"{a}-{b}" for a, b in _runs(x)) for t, x in slots.items()}
        return {"columns": ",".join(d.columns), "slots": ranges, "databases": {t: db for t, db in d.slots.values()}, "hash_range": d.hash_range}

    return {"tables": [{"name": t.name, "composed": t.composed, "decoder": t.decoder, "mapping": t.mapping, "dimensions": [dimension(d) for d in t.dimensions]} for t in tables.values()]}


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def even(columns: str, name: str, shards: int = 8, databases: int = 2) -> Dimension:
    """Equal slot ranges over ``shards`` tables on ``databases`` databases."""
    step, per = SLOTS // shards, shards // databases
    slots = {f"{name}_{i}": f"{i * step}-{(i + 1) * step - 1}" for i in range(shards)}
    routes = {f"{name}_[{d * per}-{(d + 1) * per - 1}]": f"shard{d + 1}db" for d in range(databases)}
    return Dimension.of(columns, slots, routes)


#: The tables that the registered queries shard: 8 shards of 128 slots each on 2 databases.
CATALOG: dict[str, Table] = {
    "orders": Table("orders", [even("o_custkey", "orders")], ["order_id"], "composed", ["o_orderkey"]),
    "customer": Table("customer", [even("c_custkey", "customer")], ["c_custkey"], "hash", ["c_name"]),
    "lineitem": Table("lineitem", [even("l_partkey", "lineitem_part"), even("l_suppkey", "lineitem_supp")], [], "two_dim", ["l_orderkey"]),
    "events": Table("events", [even("user_id", "events_user"), even("event_id", "events_event")], [], "two_dim", ["event_id"]),
}


def shard_map(spark: SparkSession, tables: dict[str, Table] = CATALOG) -> DataFrame:
    """table, dim, slot, shard, physical_table, database of the whole catalog: 1024 rows for each dimension."""
    rows = [(t.name, i, s, d.shard_of(s), *d.slots[s]) for t in tables.values() for i, d in enumerate(t.dimensions) for s in d.slots]
    return spark.createDataFrame(rows, "table string, dim int, slot int, shard int, physical_table string, database string")
