"""Shards that all match the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seed within each source, a row's fractional rank is its place in its source, less an offset of
the source's own below 1, divided by the source's rows, and all rows sorted by fractional rank are cut into equal runs.
The offsets spread small sources over all shards and leave no ties between sources of one size. Places come from counts
of buckets, so neither a source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch
from shardloom.llm.mixing import BROADCAST_SOURCES, uniform

BUCKET_ROWS = 20_000


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, copy, shard, slot, frac for every row of ``docs``.

    Shards hold counts of rows at most one apart and each source in proportion; ``slot`` counts from 0 in a shard.
    Null texts count as empty (size 1), null sources are a source of their own, null ids and repeated rows are placed
    like all others (equal rows are interchangeable), a very long text is a row like others, an empty table gives an
    empty result. Other columns are ignored, whatever their names. The assignment depends on the rows, ``shards`` and
    ``seed`` only.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    # equal rows, whose number nothing bounds, meet as counts and get places of their own
    rows = rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("m"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("m")
    rows = scratch.keep(rows.withColumn("u", uniform(F.lit(str(seed)), F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("copy"))))
    sources = scratch.keep(rows.groupBy("source").agg(F.count("*").alias("n")))
    few = sources.count() <= BROADCAST_SOURCES
    total = sources.agg(F.sum("n")).first()[0] or 0
    near = lambda t: F.broadcast(t) if few else t

    named = sources.withColumnRenamed("source", "_source")
    rows = rows.join(near(named), rows.source.eqNullSafe(named["_source"])).drop("_source")
    rows = rows.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n") / BUCKET_ROWS)))
    order = ["u", "doc_id", "size", "text_crc32", "copy"]
    sums = rows.groupBy("source", "bucket").agg(F.count("*").alias("c"))
    sums = sums.withColumn("base", F.sum("c").over(Window.partitionBy("source").orderBy("bucket")) - F.col("c"))
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "base")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*order)))
    rows = rows.join(sums, rows.source.eqNullSafe(sums["_source"]) & (rows.bucket == sums["_bucket"])).drop("_source", "_bucket")
    offset = uniform(F.lit(str(seed)), F.lit("source"), F.col("source"))
    rows = rows.withColumn("frac", (F.col("base") + F.col("i") - offset) / F.col("n"))

    rows = scratch.keep(rows.select("doc_id", "source", "size", "text_crc32", "copy", "u", "frac", F.floor(F.col("frac") * max(1, -(-total // BUCKET_ROWS))).alias("run")))
    runs = rows.groupBy("run").agg(F.count("*").alias("c"))
    runs = runs.select("run", (F.sum("c").over(Window.orderBy("run")) - F.col("c")).alias("base"))  # one row for BUCKET_ROWS
    last = Window.partitionBy("run").orderBy("frac", F.col("source").asc_nulls_last(), *order)
    rows = rows.withColumn("i", F.row_number().over(last)).join(runs, "run")
    place = F.col("base") + F.col("i") - 1
    rows = rows.withColumn("place", place).withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}").cast("int"))
    slot = F.col("place") - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return rows.select("doc_id", "source", "size", "text_crc32", "copy", "shard", slot.cast("long").alias("slot"), "frac")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> None:
    """Writes the rows of ``docs`` under ``path``/shard=N with their slots, in slot order within each file.

    Where ``docs`` has a column shard or slot, the new one's name gets underscores. Rows with one id and source and
    equal texts take their copies' places in any order.
    """
    placed = assign_shards(docs, shards, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = ["_id", "_source", "_size", "_crc", "_copy"]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), (F.octet_length(data) + 1).cast("long").alias("_size"), F.crc32(data).alias("_crc"))
    whole = whole.withColumn("_copy", F.row_number().over(Window.partitionBy(*key[:4]).orderBy(F.xxhash64("_row"))).cast("long"))
    placed = placed.toDF("p_id", "p_source", "p_size", "p_crc", "p_copy", "p_shard", "p_slot", "p_frac")
    on = [whole[k].eqNullSafe(placed[f"p{k}"]) for k in key]
    names = {x: x + "_" * sum(c.rstrip("_") == x for c in docs.columns) for x in ("shard", "slot")}
    out = whole.join(placed, on[0] & on[1] & on[2] & on[3] & on[4]).select("_row.*", F.col("p_shard").alias(names["shard"]), F.col("p_slot").alias(names["slot"]))
    out.repartitionByRange(names["shard"], names["slot"]).sortWithinPartitions(names["shard"], names["slot"]).write.partitionBy(names["shard"]).parquet(path)
