"""Queries of windowed statistics, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.text import sampling_rate
from shardloom.operators import telemetry as T
from shardloom.operators.merge import number_rows
from shardloom.plans.registry import query
from shardloom.sources.tables import table, work_folder
from shardloom.streaming import telemetry as ST
from shardloom.streaming.fuse import fuse_stream

_HOUR = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS win, event_type AS grp, {k}sum(CAST(value AS DECIMAL(18,2))) AS total, count(*) AS n FROM events GROUP BY ALL"
_S = f"WITH s AS ({_HOUR.format(k='')})"
_P = f"WITH s AS ({_HOUR.format(k='user_id % 10 AS pattern, ')}), g AS ({_HOUR.format(k='')})"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("grp"), (F.col("user_id") % 10).alias("pattern"), F.col("value").cast("decimal(18,2)").alias("millis"), "user_id")



def _doubles(df):
    return df.withColumn("total", F.col("total").cast("double")).withColumn("avg", F.col("total") / F.col("n"))


@query("win_fixed_job", "SELECT event_id, time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND AS due FROM events")
def win_fixed_job(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (T.fixed_window(F.col("ts"), "10 seconds") + F.expr("INTERVAL 10 SECONDS")).alias("due"))


@query("win_sql_sample", _P + " SELECT win, grp, pattern, total::DOUBLE AS total, n, total::DOUBLE / n AS avg, 1000 * n / (total::DOUBLE + 0.001) AS qps FROM s")
def win_sql_sample(spark, sf_dir):
    s = _doubles(T.samples(_events(spark, sf_dir), "1 hour", "grp", "pattern"))
    return s.select("win", "grp", "pattern", "total", "n", "avg", (1000 * F.col("n") / (F.col("total") + 0.001)).alias("qps"))


@query("win_group_sample", _S + " SELECT win, grp, total::DOUBLE AS total, n, total::DOUBLE / n AS avg FROM s")
def win_group_sample(spark, sf_dir):
    return _doubles(T.samples(_events(spark, sf_dir), "1 hour", "grp")).select("win", "grp", "total", "n", "avg")


@query("win_group_avg30", _S + " SELECT win, grp, round((sum(total) OVER w)::DOUBLE / sum(n) OVER w, 6) AS moving FROM s WINDOW w AS (PARTITION BY grp ORDER BY win ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def win_group_avg30(spark, sf_dir):
    s = T.moving_average(T.samples(_events(spark, sf_dir), "1 hour", "grp"), "grp", 30)
    return s.select("win", "grp", F.round("moving", 6).alias("moving"))


@query("win_alltime_avg", _P + " SELECT win, pattern, round((sum(t) OVER w)::DOUBLE / (sum(n) OVER w + 0.001), 6) AS ever FROM (SELECT win, pattern, sum(total) AS t, sum(n) AS n FROM s GROUP BY ALL) WINDOW w AS (PARTITION BY pattern ORDER BY win)")
def win_alltime_avg(spark, sf_dir):
    s = T.all_time_average(_doubles(T.samples(_events(spark, sf_dir), "1 hour", "pattern")), "pattern")
    return s.select("win", "pattern", F.round("ever", 6).alias("ever"))


@query("win_prev_merge", _P + ", p AS (SELECT win, pattern, sum(n)::BIGINT AS n FROM s GROUP BY ALL), b AS (SELECT pattern, min(win) AS born FROM p GROUP BY 1), f AS (SELECT w.win, b.pattern, p.n FROM (SELECT DISTINCT win FROM p) w JOIN b ON w.win >= b.born LEFT JOIN p ON p.win = w.win AND p.pattern = b.pattern) SELECT win, pattern, last_value(n IGNORE NULLS) OVER (PARTITION BY pattern ORDER BY win) AS n FROM f")
def win_prev_merge(spark, sf_dir):
    return T.carried_forward(T.samples(_events(spark, sf_dir), "1 hour", "pattern"), "pattern", "n")


_SLOW = _P + """, r AS (SELECT *, total::DOUBLE / n AS avg, lag(total::DOUBLE / n) OVER (PARTITION BY grp, pattern ORDER BY win) AS was FROM s),
q AS (SELECT win, grp, (total::DOUBLE / n) / lag(total::DOUBLE / n) OVER (PARTITION BY grp ORDER BY win) AS group_rate FROM g),
x AS (SELECT r.win, r.grp, r.pattern, r.avg / r.was AS rate, q.group_rate, r.was,
  CASE WHEN r.avg / r.was >= 1.2 AND q.group_rate >= 1.2 THEN 'sudden' WHEN r.was IS NULL AND q.group_rate >= 1.2 THEN 'new' END AS reason, r.avg
  FROM r JOIN q ON r.win = q.win AND r.grp = q.grp),
z AS (SELECT win, grp, pattern, reason, CASE reason WHEN 'sudden' THEN group_rate * ln(1 + rate) WHEN 'new' THEN avg / 1000 * group_rate / 2 END AS score FROM x WHERE reason IS NOT NULL)"""


def _scores(spark, sf_dir):
    e = _events(spark, sf_dir)
    return T.slow_scores(_doubles(T.samples(e, "1 hour", "grp", "pattern")), _doubles(T.samples(e, "1 hour", "grp")))


@query("win_slow_sudden", _SLOW + " SELECT win, grp, pattern, reason, round(score, 6) AS score FROM z")
def win_slow_sudden(spark, sf_dir):
    return _scores(spark, sf_dir).select("win", "grp", "pattern", "reason", F.round("score", 6).alias("score"))


@query("win_score", _SLOW + " SELECT win, grp, round(max(score), 6) AS score, CASE WHEN max(score) >= 10 THEN 'serious' WHEN max(score) >= 6 THEN 'possible' ELSE 'none' END AS level FROM z GROUP BY win, grp")
def win_score(spark, sf_dir):
    return T.worst_of_group(_scores(spark, sf_dir)).select("win", "grp", F.round("score", 6).alias("score"), "level")


@query("win_score_suppressed", _SLOW + ", p AS (SELECT win, grp, count(*) AS patterns FROM s GROUP BY ALL), w AS (SELECT win, grp, max(score) AS score, count(*) AS slow FROM z GROUP BY ALL) SELECT w.win, w.grp, round(w.score, 6) AS score FROM w JOIN p USING (win, grp) WHERE NOT (slow >= 3 AND slow * 2 >= patterns)")
def win_score_suppressed(spark, sf_dir):
    patterns = T.samples(_events(spark, sf_dir), "1 hour", "grp", "pattern").groupBy("win", "grp").agg(F.count("*").alias("patterns"))
    return T.worst_of_group(_scores(spark, sf_dir), patterns=patterns, many=3).select("win", "grp", F.round("score", 6).alias("score"))


@query("win_slow_ddl", _S + " SELECT win, total::DOUBLE / n / 200 AS score FROM s WHERE grp = 'error'")
def win_slow_ddl(spark, sf_dir):
    return T.ddl_scores(_doubles(T.samples(_events(spark, sf_dir), "1 hour", "grp")), F.col("grp") == "error").select("win", "score")


@query("win_warmup", _S + " SELECT win, grp, n FROM (SELECT *, dense_rank() OVER (ORDER BY win) AS i FROM s) WHERE i >= 3")
def win_warmup(spark, sf_dir):
    return T.after_warmup(T.samples(_events(spark, sf_dir), "1 hour", "grp"), 2).select("win", "grp", "n")


@query("win_ring", _S + " SELECT win, grp, sum(CASE WHEN n > 1 THEN n ELSE 0 END) OVER w::BIGINT AS ring_sum, count(*) OVER w = 5 AND min(CASE WHEN n > 1 THEN n ELSE 0 END) OVER w > 0 AS all_match FROM s WINDOW w AS (PARTITION BY grp ORDER BY win ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win_ring(spark, sf_dir):
    s = T.samples(_events(spark, sf_dir), "1 hour", "grp").withColumn("some", F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return T.ring(s, 5, "win", "some", "grp").select("win", "grp", "ring_sum", "all_match")


@query("win_qps", "SELECT w AS win, count(*) AS n FROM (SELECT unnest(range(0, 6)) AS k, ts FROM events), LATERAL (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS w) WHERE ts >= w AND ts < w + INTERVAL 1 HOUR GROUP BY 1")
def win_qps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour", "10 minutes")["start"].alias("win")).agg(F.count("*").alias("n"))


@query("win_policing", "SELECT user_id, event_id, max(t - i * 500) OVER (PARTITION BY user_id ORDER BY t, event_id) + i * 500 AS send_at FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS i FROM events)")
def win_policing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return T.leaky_bucket(e, "t", 2, "user_id").select("user_id", F.col("id").alias("event_id"), "send_at")


@query("win_hang", "SELECT DISTINCT a.h AS scan, a.user_id AS id FROM (SELECT DISTINCT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT // 3600 AS h, user_id FROM events) a JOIN (SELECT DISTINCT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT // 3600 AS h, user_id FROM events) b ON a.user_id = b.user_id AND a.h = b.h + 1")
def win_hang(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scans = e.select(F.expr("unix_timestamp(cast(ts as timestamp)) div 3600").alias("scan"), F.col("user_id").alias("id")).distinct()
    return T.hanging(scans)


@query("win_fuse", "WITH t AS (SELECT user_id % 10 AS grp, epoch_us(ts) // 3600000000 AS tick, count(*) FILTER (WHERE event_type = 'error') AS killed, count(*) FILTER (WHERE event_type <> 'error') AS passed FROM events GROUP BY ALL) SELECT grp, tick, k::BIGINT AS k, p::BIGINT AS p, (c = 5 AND k > 0 AND p > 0 AND p // greatest(k, 1) <= 3) AS tripped FROM (SELECT grp, tick, sum(killed) OVER w AS k, sum(passed) OVER w AS p, count(*) OVER w AS c FROM t WINDOW w AS (PARTITION BY grp ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
def win_fuse(spark, sf_dir):
    return T.fuse(_ticks(spark, sf_dir), 5, 3, "grp").select("grp", "tick", "k", "p", "tripped")


@query("win_sample_audit", "WITH r AS (SELECT *, CASE WHEN value < 10 THEN 1000 WHEN value < 100 THEN 100 WHEN value < 1000 THEN 10 ELSE 1 END AS rate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT event_id, user_id, i = 1 AS first FROM r WHERE i = 1 OR CAST('0x' || substr(md5(event_id::VARCHAR), 1, 8) AS BIGINT) % rate = 0")
def win_sample_audit(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    e = e.withColumn("first", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1)
    return T.audit_sample(e, "user_id", "event_id", sampling_rate(F.col("value")), "ts").select("event_id", "user_id", "first")


@query("win_int_overflow", "SELECT * FROM (SELECT 'l_orderkey' AS \"column\", max(l_orderkey) AS most, 32766::BIGINT AS \"limit\", max(l_orderkey) > 32766 AS over FROM lineitem UNION ALL SELECT 'l_partkey', max(l_partkey), 1672369200, max(l_partkey) > 1672369200 FROM lineitem UNION ALL SELECT 'l_suppkey', max(l_suppkey), 4194303, max(l_suppkey) > 4194303 FROM lineitem UNION ALL SELECT 'big', max(l_orderkey) * 1000000, 3344738400, max(l_orderkey) * 1000000 > 3344738400 FROM lineitem)")
def win_int_overflow(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("big", F.col("l_orderkey") * 1_000_000)
    return T.int_overflow(df, {"l_orderkey": "smallint unsigned", "l_partkey": "int", "l_suppkey": "mediumint", "big": "int unsigned"})


@query("win_query_stats", "SELECT user_id, sum(t - b)::BIGINT AS dur FROM (SELECT user_id, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1")
def win_query_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return T.query_spans(e, "user_id", F.unix_millis(F.col("ts").cast("timestamp")), "ts", "event_id")


# streams: closed windows only


def _closed(width: str) -> str:
    """The condition that a window's end isn't after the watermark that the last event leaves."""
    return f"win + INTERVAL {width} <= (SELECT max(ts) FROM events)"


@query("stream_samples", f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS win, event_type AS grp, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total, count(*) AS n FROM events GROUP BY ALL) WHERE {_closed('1 HOUR')} - INTERVAL 10 MINUTE")
def stream_samples(spark, sf_dir):
    path = work_folder(spark, "stream-in")
    table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)")).repartitionByRange(4, "ts").write.parquet(path)
    out = ST.drain(ST.windowed_samples(ST.event_stream(spark, path, 4)), work_folder(spark, "stream-out"))
    return out.select(F.col("win").cast("timestamp_ntz").alias("win"), "grp", F.col("total").cast("double").alias("total"), "n")


@query("stream_sliding_rate", f"SELECT * FROM (SELECT w AS win, count(*) AS n FROM (SELECT unnest(range(0, 2)) AS k, ts FROM events), LATERAL (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w) WHERE ts >= w AND ts < w + INTERVAL 1 HOUR GROUP BY 1) WHERE {_closed('1 HOUR')} - INTERVAL 1 MINUTE")
def stream_sliding_rate(spark, sf_dir):
    path = work_folder(spark, "stream-in")
    table(spark, sf_dir, "events").repartitionByRange(2, "ts").write.parquet(path)
    out = ST.drain(ST.sliding_rate(ST.event_stream(spark, path, 2), "1 hour", "30 minutes"), work_folder(spark, "stream-out"))
    return out.select(F.col("win").cast("timestamp_ntz").alias("win"), "n")


@query("stream_first_sights", "SELECT user_id, 1::BIGINT AS n FROM events GROUP BY 1")
def stream_first_sights(spark, sf_dir):
    """Each user once, however many events are in how many files."""
    path = work_folder(spark, "stream-in")
    table(spark, sf_dir, "events").select("user_id", "ts").repartitionByRange(4, "ts").write.parquet(path)
    return ST.drain(ST.first_sights(ST.event_stream(spark, path, 4), late="60 days"), work_folder(spark, "stream-out")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("win_slow_gate", _P + ", h AS (SELECT win, grp, n, total::DOUBLE / n AS avg, (sum(total) OVER w)::DOUBLE / sum(n) OVER w AS history FROM g WINDOW w AS (PARTITION BY grp ORDER BY win ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT s.win, s.grp, s.pattern FROM s JOIN h ON s.win = h.win AND s.grp = h.grp WHERE s.total::DOUBLE / s.n > 60 AND h.n > 1 AND h.avg > 1.5 * h.history")
def win_slow_gate(spark, sf_dir):
    """The events of a window stand for its queue; 60 milliseconds are slow here."""
    e = _events(spark, sf_dir)
    groups, patterns = _doubles(T.samples(e, "1 hour", "grp")), _doubles(T.samples(e, "1 hour", "grp", "pattern"))
    return T.slow_gate(patterns, groups, F.col("n"), least_avg=60)


@query("win_slow_new", _SLOW + " SELECT win, grp, pattern, round(score, 6) AS score FROM z WHERE reason = 'new'")
def win_slow_new(spark, sf_dir):
    return _scores(spark, sf_dir).where("reason = 'new'").select("win", "grp", "pattern", F.round("score", 6).alias("score"))


@query("win_slow_qps", _S + ", b AS (SELECT *, lag(n) OVER (PARTITION BY grp ORDER BY win) AS was FROM s) SELECT win, grp, CASE WHEN n >= 1.5 * was THEN 'more requests' ELSE 'slow statements' END AS reason FROM b WHERE was IS NOT NULL")
def win_slow_qps(spark, sf_dir):
    return T.slowness_reasons(T.samples(_events(spark, sf_dir), "1 hour", "grp"))


@query("sort_pattern_avg", "SELECT user_id, row_number() OVER (ORDER BY sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / (count(*) + 0.001::DOUBLE) DESC, user_id) AS place FROM events GROUP BY user_id")
def sort_pattern_avg(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("t"), F.count("*").alias("n"))
    return number_rows(s, [F.desc(F.col("t") / (F.col("n") + F.lit(0.001))), F.col("user_id")]).select("user_id", "place")


@query("sort_priority_queue", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS place FROM events")
def sort_priority_queue(spark, sf_dir):
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return T.in_priority(table(spark, sf_dir, "events"), priority, "event_id", "user_id").select("event_id", "place")


def _ticks(spark, sf_dir):
    """The events' errors and others by hour, for each tenth of the users."""
    hour = F.expr("unix_timestamp(cast(ts as timestamp)) div 3600")
    ticks = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("grp"), hour.alias("tick"))
    return ticks.agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("killed"), F.count(F.when(F.col("event_type") != "error", 1)).alias("passed"))


@query("stream_fuse")
def stream_fuse(spark, sf_dir):
    """The events' errors and others by hour as ticks of one fuse for each tenth of the users."""
    path = work_folder(spark, "ticks")
    # a group's ticks are in one file, so they come in one trigger
    _ticks(spark, sf_dir).withColumn("grp", F.col("grp").cast("string")).repartition(4, "grp").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return ST.drain(fuse_stream(stream), work_folder(spark, "fuse"))
