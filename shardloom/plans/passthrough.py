"""What sharding leaves to SQL: the same text in both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.plans.registry import query, same_sql
from shardloom.sources.tables import table

_D = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_REV = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"

for _name, _text in {
    "proj_columns": "SELECT o_orderkey AS k, o_custkey + 1 AS next_cust, CONCAT(o_orderstatus, '-', o_orderpriority) AS tag FROM {orders}",
    "filt_where": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 150000 AND o_orderstatus <> 'F'",
    "filt_eq": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = 7",
    "filt_in": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (7, 8, 9) AND o_orderstatus NOT IN ('P')",
    "filt_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12 AND l_discount <= 0.02",
    "filt_and_or": "SELECT o_orderkey FROM {orders} WHERE o_custkey = 100 AND (o_orderkey < 5000 OR o_orderstatus = 'O')",
    "filt_null": "SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c FROM {orders}) t WHERE c IS NULL OR c NOT BETWEEN 1 AND 700",
    "filt_like": "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%A%' AND p_brand NOT LIKE '%1'",
    "filt_exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "filt_case": "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM {lineitem} GROUP BY 1",
    "filt_not_in_subquery": "SELECT count(*) AS n FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)",
    "join_inner": f"SELECT c_mktsegment, count(*) AS n, {_D.format('o_totalprice')} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, count(o_orderkey) AS n FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_full": "SELECT count(*) AS n, count(a.k) AS l, count(b.k) AS r FROM (SELECT o_custkey AS k FROM {orders} WHERE o_orderkey % 3 = 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM {customer} WHERE c_custkey % 2 = 0) b ON a.k = b.k",
    "join_cross": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority LIKE '1%')",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_theta": "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_star": f"SELECT n_name, {_REV} AS revenue FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_self": "SELECT count(*) AS n FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey",
    "agg_avg": "SELECT o_orderpriority, CAST(AVG(CAST(o_custkey AS DOUBLE)) AS DOUBLE) AS mean FROM {orders} GROUP BY o_orderpriority",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus",
    "agg_bits": "SELECT bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM {orders}",
    "agg_rollup": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {_D.format('o_totalprice')} AS total FROM {{orders}} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_filter": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM {orders}",
    "agg_pricing_summary": f"SELECT l_returnflag, l_linestatus, {_D.format('l_quantity')} AS qty, {_REV} AS revenue, count(*) AS n FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}",
    "win_rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM {part}",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM {customer}",
    "win_percent_rank": "SELECT p_partkey, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS p, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS c FROM {part}",
    "win_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2 FROM {events}",
    "win_first_last": "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {events}",
    "win_running_sum": "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total FROM {orders}",
    "win_moving_max": "SELECT event_id, max(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM {events}",
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "sub_scalar": "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM {customer})",
    "sub_correlated": "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "cte_chain": "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT c_name, n FROM top JOIN {customer} ON c_custkey = o_custkey",
    "fn_string": "SELECT p_partkey, upper(p_brand) AS u, length(p_name) AS n, substring(p_name, 2, 3) AS s, replace(p_type, 'A', '*') AS r, trim(concat(' ', p_brand, ' ')) AS t FROM {part}",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM {orders}",
    "fn_hour": "SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m FROM {events}",
    "fn_math": "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice / 100) AS BIGINT) AS f, p_size % 7 AS m, greatest(p_size, 10) AS g, coalesce(nullif(p_size, 1), 0) AS z FROM {part}",
    "fn_md5": "SELECT c_custkey, md5(c_name) AS h FROM {customer}",
}.items():
    same_sql(_name, _text)


@query("agg_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_group_concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("agg_std_var", "SELECT o_orderstatus, round(stddev_pop(o_custkey), 4) AS sp, round(stddev_samp(o_custkey), 4) AS ss, round(var_pop(o_custkey), 2) AS vp, round(var_samp(o_custkey), 2) AS vs FROM orders GROUP BY 1")
def agg_std_var(spark, sf_dir):
    f = lambda g, n: F.round(g("o_custkey"), n)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(f(F.stddev_pop, 4).alias("sp"), f(F.stddev_samp, 4).alias("ss"), f(F.var_pop, 2).alias("vp"), f(F.var_samp, 2).alias("vs"))


@query("join_range", "SELECT a.event_id, count(b.event_id) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts AND b.event_id <> a.event_id GROUP BY 1")
def join_range(spark, sf_dir):
    """Pairs within an hour: buckets of an hour as an equi-join key, then the exact condition."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    a = e.select("event_id", "user_id", "ts", F.explode(F.array(hour, hour - 1)).alias("h"))
    b = e.select(F.col("event_id").alias("id2"), F.col("user_id").alias("u2"), F.col("ts").alias("ts2"), hour.alias("h2"))
    near = (F.col("ts2") <= F.col("ts")) & (F.col("ts2") >= F.col("ts") - F.expr("INTERVAL 1 HOUR")) & (F.col("id2") != F.col("event_id"))
    joined = a.join(b, (F.col("user_id") == F.col("u2")) & (F.col("h") == F.col("h2")) & near)
    return joined.groupBy("event_id").agg(F.count("id2").alias("near"))


@query("join_asof", "SELECT a.event_id, b.event_id AS last_login FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, max(event_id) AS event_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark, sf_dir):
    """The latest view before each purchase: one window over both, instead of a join."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(w)
    return e.withColumn("ts", ts).withColumn("seen", seen).where("event_type = 'purchase'").select("event_id", F.col("seen.event_id").alias("last_login"))


@query("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def agg_pivot(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("filt_regexp", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(^|[ _])[a-z]*[0-9]*[13579]$')")
def filt_regexp(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike("(^|[ _])[a-z]*[0-9]*[13579]$")).select("p_partkey")


@query("fn_array", "SELECT o_custkey, len(list_distinct(list(o_orderstatus))) AS kinds, list_sort(list(o_orderkey))[1] AS first, len(list_filter(list(o_orderkey), lambda x: x % 2 = 0)) AS even FROM orders GROUP BY 1")
def fn_array(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"), F.collect_list("o_orderkey").alias("k"))
    even = F.size(F.filter("k", lambda x: x % 2 == 0))
    return o.select("o_custkey", F.size(F.array_distinct("s")).cast("long").alias("kinds"), F.array_min("k").alias("first"), even.cast("long").alias("even"))


@query("fn_map", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def fn_map(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    m = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select("o_custkey", F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0)).alias("f"), F.size(F.map_keys("m")).cast("long").alias("kinds"))
