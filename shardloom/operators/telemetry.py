"""Windowed statistics of statements and the detection of slow ones, over event time.

``events`` has ts (timestamp), grp (group), pattern, millis. All forms are grouped aggregates and windows over the
aggregated rows, so that raw events are shuffled once, already pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_window(ts: Column, width: str) -> Column:
    """The start of the event's wall-clock-aligned window."""
    return F.window(ts, width)["start"]


def samples(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """win, keys, total, n, avg, qps in each window: qps = 1000 n / (total + 0.001)."""
    grouped = events.groupBy(fixed_window(F.col("ts"), width).alias("win"), *keys).agg(F.sum("millis").alias("total"), F.count("*").alias("n"))
    return grouped.withColumn("avg", F.col("total") / F.col("n")).withColumn("qps", 1000 * F.col("n") / (F.col("total") + 0.001))


def moving_average(samples: DataFrame, key: str, windows: int = 30) -> DataFrame:
    """The mean over a key's last ``windows`` windows, weighted by counts."""
    w = Window.partitionBy(key).orderBy("win").rowsBetween(1 - windows, 0)
    return samples.withColumn("moving", F.sum("total").over(w).cast("double") / F.sum("n").over(w))


def all_time_average(samples: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("ever", F.sum("total").over(w) / (F.sum("n").over(w) + 0.001))


def carried_forward(samples: DataFrame, key: str, value: str, width: str = "1 hour") -> DataFrame:
    """Each key in every window from its first on, with its last value where it has none.

    A sample holds until its key's next one, or to the last window; windows without any sample don't count.
    """
    step = F.expr(f"INTERVAL {width}")
    end = samples.agg(F.max("win")).first()[0]
    following = F.lead("win").over(Window.partitionBy(key).orderBy("win"))
    held = samples.select("win", key, value).withColumn("_to", F.coalesce(following - step, F.lit(end).cast(samples.schema["win"].dataType)))
    spread = held.withColumn("win", F.explode(F.sequence("win", "_to", step))).drop("_to")
    return spread.join(samples.select("win").distinct(), "win", "left_semi").select("win", key, value)


def slow_scores(samples: DataFrame, groups: DataFrame, queue: Column | None = None) -> DataFrame:
    """win, grp, pattern, rate, group_rate, reason, score of patterns that got slower than in their previous window.

    A pattern that is slower by 1.2 or more in a group that is slower too scores group rate * log(1 + rate); one
    without a previous window scores its mean in seconds * group rate / 2; scores grow with the queue's root.
    """
    before = Window.partitionBy("grp", "pattern").orderBy("win")
    rated = samples.withColumn("was", F.lag("avg").over(before))
    g = groups.withColumn("g_was", F.lag("avg").over(Window.partitionBy("grp").orderBy("win")))
    g = g.select("win", "grp", (F.col("avg") / F.col("g_was")).alias("group_rate"))
    joined = rated.join(g, ["win", "grp"]).withColumn("rate", F.col("avg") / F.col("was"))
    sudden = F.when((F.col("rate") >= 1.2) & (F.col("group_rate") >= 1.2), F.col("group_rate") * F.log1p("rate"))
    new = F.when(F.col("was").isNull() & (F.col("group_rate") >= 1.2), F.col("avg") / 1000 * F.col("group_rate") / 2)
    score = F.coalesce(sudden, new) * F.sqrt(F.greatest(F.lit(1.0), queue if queue is not None else F.lit(1.0)))
    reason = F.when(sudden.isNotNull(), "sudden").when(new.isNotNull(), "new")
    return joined.select("win", "grp", "pattern", "rate", "group_rate", reason.alias("reason"), score.alias("score")).where("score is not null")


def worst_of_group(scores: DataFrame, possible: float = 6.0, serious: float = 10.0, patterns: DataFrame | None = None, many: int = 8) -> DataFrame:
    """The pattern with the greatest score in each window and group, with its level.

    With ``patterns`` (win, grp, patterns: how many it has in all) a group is left out of a window in which ``many`` of
    its patterns or more, and at least half of them, got slow: it isn't one statement's fault.
    """
    worst = scores.groupBy("win", "grp").agg(F.max(F.struct("score", "pattern")).alias("x"), F.count("*").alias("slow"))
    if patterns is not None:
        worst = worst.join(patterns, ["win", "grp"]).where(~((F.col("slow") >= many) & (F.col("slow") * 2 >= F.col("patterns"))))
    level = F.when(F.col("x.score") >= serious, "serious").when(F.col("x.score") >= possible, "possible").otherwise("none")
    return worst.select("win", "grp", F.col("x.pattern").alias("pattern"), F.col("x.score").alias("score"), level.alias("level"))


def ring(df: DataFrame, n: int, order: str, value: str, *keys: str) -> DataFrame:
    """The sum of each key's last n values and whether a full ring has only positive ones (places not yet filled are 0)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    full = (F.count("*").over(w) == n) & (F.min(value).over(w) > 0)
    return df.withColumn("ring_sum", F.sum(value).over(w)).withColumn("all_match", full)


def leaky_bucket(df: DataFrame, time: str, per_second: int, *keys: str) -> DataFrame:
    """When each event may be sent: max(last + period, its time), as a running maximum instead of a recurrence."""
    w = Window.partitionBy(*keys).orderBy(time, "id")
    i = F.row_number().over(w) - 1
    period = 1000 // per_second
    ranked = df.withColumn("_i", i)
    return ranked.withColumn("send_at", F.max(F.col(time) - F.col("_i") * period).over(w) + F.col("_i") * period).drop("_i")


def hanging(scans: DataFrame) -> DataFrame:
    """Ids seen in two scans that follow each other."""
    w = Window.partitionBy("id").orderBy("scan")
    return scans.withColumn("before", F.lag("scan").over(w)).where("scan = before + 1").select("scan", "id")


def fuse(df: DataFrame, n: int, rate: int, *keys: str) -> DataFrame:
    """Whether the last n ticks trip the fuse: some killed, some passed, and passed div killed at most ``rate``."""
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(1 - n, 0)
    sums = df.withColumn("k", F.sum("killed").over(w)).withColumn("p", F.sum("passed").over(w)).withColumn("c", F.count("*").over(w))
    trip = (F.col("c") == n) & (F.col("k") > 0) & (F.col("p") > 0) & F.when(F.col("k") > 0, F.floor(F.col("p") / F.col("k")) <= rate).otherwise(False)
    return sums.withColumn("tripped", trip).drop("c")


# From these on a column of the type counts as near its end; unsigned ones hold twice as much.
NEAR_END = {"smallint": 16383, "mediumint": 4194303, "int": 1672369200}


def int_overflow(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column, most, limit, over: the largest value of each integer column against the limit of its type.

    Types are those of NEAR_END, "unsigned" may follow.
    """
    limits = {c: NEAR_END[t.split()[0]] * (2 if t.endswith(" unsigned") else 1) for c, t in types.items()}
    tops = df.agg(*(F.max(c).cast("long").alias(c) for c in limits))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("most"), F.lit(v).cast("long").alias("limit")) for c, v in limits.items())))
    return tops.select(pairs.alias("x")).select("x.*").withColumn("over", F.coalesce(F.col("most") > F.col("limit"), F.lit(False)))


def group_rates(groups: DataFrame) -> DataFrame:
    """win, grp, group_rate: each group's mean against its previous window's."""
    was = F.lag("avg").over(Window.partitionBy("grp").orderBy("win"))
    return groups.withColumn("group_rate", F.col("avg") / was).select("win", "grp", "group_rate")


def slow_gate(samples: DataFrame, groups: DataFrame, queue: Column, least_avg: float = 200.0, rate: float = 1.5, windows: int = 30, least_queue: int = 1) -> DataFrame:
    """win, grp, pattern of what is worth a score: patterns whose mean is above ``least_avg`` milliseconds, in groups with
    a queue above ``least_queue`` whose mean is above ``rate`` times that of their last ``windows`` windows before."""
    past = Window.partitionBy("grp").orderBy("win").rowsBetween(-windows, -1)
    history = F.sum("total").over(past) / F.sum("n").over(past)
    busy = groups.withColumn("_queue", queue).withColumn("_history", history).where((F.col("_queue") > least_queue) & (F.col("avg") > rate * F.col("_history")))
    return samples.where(F.col("avg") > least_avg).join(busy.select("win", "grp"), ["win", "grp"], "left_semi").select("win", "grp", "pattern")


def slowness_reasons(groups: DataFrame, rate: float = 1.5) -> DataFrame:
    """win, grp, reason: whether a group's requests grew by ``rate`` against its previous window, or its statements got slow."""
    rated = groups.withColumn("was", F.lag("n").over(Window.partitionBy("grp").orderBy("win")))
    reason = F.when(F.col("n") >= rate * F.col("was"), "more requests").otherwise("slow statements")
    return rated.where("was is not null").select("win", "grp", reason.alias("reason"))


def ddl_scores(samples: DataFrame, kind: Column, millis: float = 200.0) -> DataFrame:
    """win, grp, score of changes to tables: their mean by ``millis``."""
    return samples.where(kind).select("win", "grp", (F.col("avg") / millis).alias("score"))


def after_warmup(samples: DataFrame, windows: int = 2) -> DataFrame:
    """Samples without those of the first ``windows`` windows of all."""
    firsts = samples.select("win").distinct().orderBy("win").limit(windows).agg(F.max("win").alias("_until"))
    return samples.join(F.broadcast(firsts), F.col("_until").isNull() | (F.col("win") > F.col("_until"))).drop("_until")  # one row


def query_spans(events: DataFrame, key: str, time: Column, *order: str) -> DataFrame:
    """key, dur: the milliseconds between each key's following events, added up."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_t", time).select(key, (F.col("_t") - F.lag("_t").over(w)).alias("_d")).groupBy(key).agg(F.sum("_d").alias("dur"))


def audit_sample(events: DataFrame, pattern: str, id_col: str, rate: Column, order: str) -> DataFrame:
    """What is audited: each pattern's first event always, of the others one of ``rate``, by a hash of the event's id."""
    first = events.groupBy(pattern).agg(F.min(F.struct(order, id_col)).alias("x")).select(F.col(f"x.{id_col}").alias(id_col)).withColumn("_first", F.lit(True))
    part = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    marked = events.join(first, id_col, "left")
    return marked.where(F.coalesce("_first", F.lit(False)) | (part % rate == 0)).drop("_first")


def in_priority(df: DataFrame, priority: Column, order: str, *keys: str) -> DataFrame:
    """The rows of each key's queue with their places, by priority and then in order."""
    w = Window.partitionBy(*keys).orderBy(priority, order)
    return df.withColumn("place", F.row_number().over(w).cast("long"))
