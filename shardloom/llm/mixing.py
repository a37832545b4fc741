"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words; a document gets as many certain whole copies as the target holds the source, and
one more copy for those that a fixed-size sample with unequal probabilities picks. The sample takes documents in the
order of their random odds divided by their inclusion odds until the words still wanted are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch

#: Rows of a source in one bucket of the order, about; only one bucket of each source is put in exact order.
BUCKET_ROWS = 4096
#: More sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """The number of runs of characters other than U+0020 and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that the columns' values decide: 48 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *columns).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def _sources(rows: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, n, target: targets by weight, none above ``most`` times its source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sizes = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # sources in the order in which a rising level reaches their caps: those that it passes keep their caps
    everything, level = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    past = level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    sizes = sizes.withColumn("free", total - F.coalesce(F.sum("source_size").over(past), F.lit(0)) * F.lit(float(most)))
    sizes = sizes.withColumn("free_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(past), F.lit(0.0)))
    sizes = sizes.withColumn("per", F.col("free") / F.col("free_w"))
    capped = F.col("per") * F.col("w") > F.col("source_size") * F.lit(float(most))
    sizes = sizes.withColumn("capped", capped).withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), "per"))).over(everything))
    target = F.when(F.col("capped"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("final.per") * F.col("w"))
    return sizes.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: list[float] | None = None,
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 17,
    prefer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each row.

    ``weights`` go to the sources by code point, null last, and repeat (1, 2, 3 by default); targets share
    ``share`` of all words and none is above ``most`` times its source: what is above goes to the others by weight.
    ``prefer`` names a column of positive weights that inclusion probabilities follow within a source (all equal
    without it). Whole documents are taken, so a source's words come as near its target as the documents around the
    cut allow. Null texts have size 0; a null source is a source; repeated rows are sampled one by one; null ids are
    carried. The result depends on the rows and ``seed`` only, not on their order or partitions.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    liking = F.greatest(F.col(prefer).cast("double"), F.lit(1e-6)) if prefer else F.lit(1.0)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(liking, F.lit(1.0)).alias("liking")
    )
    rows = scratch.keep(rows.groupBy("doc_id", "source", "size", "liking").agg(F.count("*").alias("m")))
    rows = rows.select("doc_id", "source", "size", "liking", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy"))

    plan = _sources(rows, weights or [1.0, 2.0, 3.0], share, most)
    likings = rows.groupBy("source").agg(F.avg("liking").alias("liking_avg"))
    plan = plan.join(likings, plan.source.eqNullSafe(likings.source)).select(plan["*"], "liking_avg")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = plan.withColumn("chance", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    plan = scratch.keep(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)))
    few = plan.count() <= BROADCAST_SOURCES
    near = lambda t: F.broadcast(t) if few else t

    def with_plan(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(near(right), left.source.eqNullSafe(right["_source"]), how).drop("_source")

    u = uniform(F.lit(str(seed)), F.col("doc_id"), F.col("copy"), F.col("size"))
    bounded = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), c))
    chance, base = bounded(F.col("chance") * F.col("liking") / F.col("liking_avg")), bounded(F.col("chance"))
    ranked = with_plan(rows, plan).withColumn("q", u / (1 - u) * (1 - chance) / chance)
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * F.col("buckets")))
    # the same order in parts of about equal sizes, whatever the chance: u itself where odds are equal
    level = F.col("q") * base / (1 - base)
    ranked = ranked.withColumn("part", F.floor(level / (1 + level) * F.col("buckets")))

    # where at most half a word is wanted no document comes nearer: such sources have no cut
    sums = ranked.where("rest > 0.5").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = with_plan(sums.withColumn("reach", F.sum("words").over(upto)), plan.select("source", "rest"))
    cut = sums.where(F.col("reach") >= F.col("rest")).groupBy("source").agg(F.min("bucket").alias("cut"), F.min("reach").alias("reach"), F.min_by("words", "bucket").alias("words"))
    cut = scratch.keep(cut.select("source", "cut", (F.col("reach") - F.col("words")).alias("before")))
    ranked = with_plan(ranked, cut, "left")

    # around the cut: in order, each document that still fits, then one that doesn't if that comes nearer
    fields = ["q", "doc_id", "copy", "size", "liking"]
    key = F.struct(*fields)
    at_cut = ranked.where("bucket = cut").select("source", "source_size", "target", "whole", (F.col("rest") - F.col("before")).alias("room"), "part", *fields)
    at_cut = scratch.keep(at_cut)
    # the part in which the first document doesn't fit, and that document
    sums = at_cut.groupBy("source", "room", "part").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("reach", F.sum("words").over(Window.partitionBy("source").orderBy("part"))).where("reach > room")
    stop = sums.groupBy("source").agg(F.min("part").alias("stop"), F.min_by(F.col("reach") - F.col("words"), "part").alias("done"))
    inside = with_plan(at_cut, stop).where("part = stop")
    ordered = Window.partitionBy("source").orderBy(*fields).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.col("done") + F.sum("size").over(ordered)).where("run > room")
    edge = inside.groupBy("source", "room", "stop").agg(F.min(key).alias("edge"), F.min("run").alias("run"))
    edge = scratch.keep(edge.select("source", "stop", "edge", (F.col("room") - F.col("run") + F.col("edge.size")).alias("left")))
    # behind it no more than left / size documents of a size fit, the first ones
    behind = with_plan(at_cut, edge).where((F.col("part") > F.col("stop")) | ((F.col("part") == F.col("stop")) & (key > F.col("edge"))))
    behind = behind.where("size > 0 and size <= left").withColumn("i", F.row_number().over(Window.partitionBy("source", "size").orderBy(*fields)))
    behind = behind.where(F.col("i") <= F.floor(F.col("left") / F.col("size"))).groupBy("source", "left").agg(F.sort_array(F.collect_list(key)).alias("rows"))
    some = F.array().cast(f"array<{at_cut.select(key.alias('k')).schema[0].dataType.simpleString()}>")

    def step(acc: Column, x: Column) -> Column:
        fits = x["size"] <= acc["left"]
        took = F.when(fits, F.concat(acc["took"], F.array(x))).otherwise(acc["took"])
        return F.struct((acc["left"] - F.when(fits, x["size"]).otherwise(0)).alias("left"), took.alias("took"))

    behind = behind.select("source", F.aggregate("rows", F.struct("left", some.alias("took")), step).alias("a"))
    edge = with_plan(edge, behind, "left").select("source", "stop", "edge", F.coalesce("a.left", "left").alias("left"), F.coalesce("a.took", some).alias("took"))
    edge = scratch.keep(edge)
    early = (F.col("part") < F.col("stop")) | ((F.col("part") == F.col("stop")) & (key < F.col("edge")))
    at_cut = with_plan(at_cut, edge, "left").withColumn("took", F.col("stop").isNull() | early | F.array_contains("took", key))
    off = F.abs(F.col("size") - F.col("left"))
    extra = at_cut.where(~F.col("took") & (F.col("size") > 0) & (off < F.col("left"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), *fields)).alias("x"))
    extra = extra.select("source", F.struct(*(F.col(f"x.{c}").alias(c) for c in fields)).alias("extra"))
    at_cut = with_plan(at_cut, scratch.keep(extra), "left")
    more = (F.col("size") > 0) & (F.col("took") | F.coalesce(key == F.col("extra"), F.lit(False)))
    at_cut = at_cut.select("doc_id", "source", "size", "source_size", "target", "whole", more.alias("more"))
    early = F.coalesce((F.col("bucket") < F.col("cut")) & (F.col("size") > 0), F.lit(False))
    others = ranked.where("cut is null or bucket <> cut").select("doc_id", "source", "size", "source_size", "target", "whole", early.alias("more"))
    out = others.union(at_cut).withColumn("copies", (F.col("whole") + F.col("more").cast("int")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
