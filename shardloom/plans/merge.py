"""Queries of aggregates, sorts and limits over shards: global and compat forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import merge as M
from shardloom.operators import routing as R
from shardloom.operators.catalog import CATALOG
from shardloom.plans.registry import query, shard_sql
from shardloom.sources.tables import table, work_folder

_D = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_SH = shard_sql("o_custkey")
_ORDERS = f"(SELECT *, {_SH} AS shard FROM orders)"


def _orders(spark, sf_dir):
    return R.with_shard(table(spark, sf_dir, "orders"), CATALOG["orders"])


def _money(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("agg_scatter_gather", f"SELECT count(*) AS n, {_D.format('o_totalprice')} AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders WHERE o_custkey IN (1, 2, 4, 5, 7, 8, 10, 11)")
def agg_scatter_gather(spark, sf_dir):
    keys = [1, 2, 4, 5, 7, 8, 10, 11]
    shards = R.shards_of(CATALOG["orders"], *R.choose_route(CATALOG["orders"], {"o_custkey": keys}))
    # the key filter reaches the scan; the shard filter prunes where the table is written by shard
    df = R.with_shard(table(spark, sf_dir, "orders").where(F.col("o_custkey").isin(keys)), CATALOG["orders"]).where(F.col("shard").isin(shards))
    price = F.col("o_totalprice")
    out = M.scatter_gather(df, {"n": ("count", F.lit(1)), "total": ("sum", price.cast("decimal(18,2)")), "least": ("min", price), "most": ("max", price)})
    return out.withColumn("total", F.col("total").cast("double"))


@query("agg_count_merge", "SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f FROM orders")
def agg_count_merge(spark, sf_dir):
    return M.scatter_gather(_orders(spark, sf_dir), {"n": ("count", F.lit(1)), "f": ("count", F.when(F.col("o_orderstatus") == "F", 1))})


@query("agg_sum_merge", f"SELECT {_D.format('CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END')} AS some, CAST(NULL AS DOUBLE) AS nothing FROM orders")
def agg_sum_merge(spark, sf_dir):
    df = _orders(spark, sf_dir)
    some = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("decimal(18,2)"))
    out = M.scatter_gather(df, {"some": ("sum", some), "nothing": ("sum", F.when(F.col("o_orderkey") < 0, F.lit(1).cast("decimal(18,2)")))})
    return out.select(F.col("some").cast("double").alias("some"), F.col("nothing").cast("double").alias("nothing"))


@query("agg_max_merge", "SELECT max(o_orderdate) AS latest, max(o_totalprice) AS most FROM orders")
def agg_max_merge(spark, sf_dir):
    return M.scatter_gather(_orders(spark, sf_dir), {"latest": ("max", F.col("o_orderdate")), "most": ("max", F.col("o_totalprice"))})


@query("agg_min_merge", "SELECT min(o_orderdate) AS first, min(CASE WHEN o_orderkey > 10 THEN o_totalprice END) AS least FROM orders")
def agg_min_merge(spark, sf_dir):
    return M.scatter_gather(_orders(spark, sf_dir), {"first": ("min", F.col("o_orderdate")), "least": ("min", F.when(F.col("o_orderkey") > 10, F.col("o_totalprice")))})


@query("agg_merge_rows", "SELECT '6' AS c_count, '3.01' AS c_sum, '12345678901234567890' AS c_max, '-2' AS c_min, NULL::VARCHAR AS c_min2")
def agg_merge_rows(spark, sf_dir):
    rows = [("1", "1", "1", "1", None), ("2", "2.01", "12345678901234567890", "-2", None), ("3", None, None, None, "abc")]
    df = spark.createDataFrame(rows, "c_count string, c_sum string, c_max string, c_min string, c_min2 string")
    return M.merge_partials(df, {"c_count": "count", "c_sum": "sum", "c_max": "max", "c_min": "min", "c_min2": "min"})


@query("agg_merge_times", "SELECT '2017-08-11' AS d, '11:11:01' AS t, '2018' AS y, '2017-08-12 11:11:00' AS s, '2017-08-12 11:11:00.10000' AS f")
def agg_merge_times(spark, sf_dir):
    rows = [("2017-08-12", "11:11:00", "2017", "2017-08-12 11:11:00", "2017-08-12 11:11:00.10000")] * 2 + [("2017-08-11", "11:11:01", "2018", "2017-08-12 11:11:01", "2017-08-12 11:11:00.10001")]
    df = spark.createDataFrame(rows, "d string, t string, y string, s string, f string")
    types = {"d": "date", "t": "time", "y": "year", "s": "datetime", "f": "datetime"}
    return M.merge_partials(df, {"d": "min", "t": "max", "y": "max", "s": "min", "f": "min"}, types)


@query("agg_merge_orders", "SELECT count(*)::VARCHAR AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders")
def agg_merge_orders(spark, sf_dir):
    """Each shard's results as texts, merged by value."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    per = _orders(spark, sf_dir).groupBy("shard").agg(F.count("*").cast("string").alias("n"), F.max(day).alias("latest"), F.min(day).alias("first"))
    return M.merge_partials(per, {"n": "count", "latest": "max", "first": "min"}, {"latest": "date", "first": "date"})


@query("agg_validate", "SELECT * FROM (VALUES ('avg', 'refused'), ('sum', 'merged')) t(func, outcome)")
def agg_validate(spark, sf_dir):
    def outcome(f):
        try:
            M.scatter_gather(_orders(spark, sf_dir), {"x": (f, F.col("o_custkey"))})
            return "merged"
        except ValueError:
            return "refused"

    return spark.createDataFrame([(f, outcome(f)) for f in ("avg", "sum")], "func string, outcome string")


@query("agg_nonagg_first_compat", f"SELECT arg_min(st, shard) AS status, sum(n)::BIGINT AS n FROM (SELECT shard, min(o_orderstatus) AS st, count(*) AS n FROM {_ORDERS} GROUP BY shard)")
def agg_nonagg_first_compat(spark, sf_dir):
    per = _orders(spark, sf_dir).groupBy("shard").agg(F.min("o_orderstatus").alias("st"), F.count("*").alias("n"))
    return per.agg(M.first_shard_value("st").alias("status"), F.sum("n").alias("n"))


for _compat in (False, True):
    _n, _k = ("_compat", "shard, ") if _compat else ("", "")

    @query(f"agg_group_by{_n}", f"SELECT o_orderpriority, count(*) AS n, {_D.format('o_totalprice')} AS total FROM {_ORDERS} GROUP BY {_k}o_orderpriority")
    def agg_group_by(spark, sf_dir, compat=_compat):
        out = M.grouped(_orders(spark, sf_dir), ["o_orderpriority"], F.count("*").alias("n"), _money("o_totalprice").alias("total"), compat=compat)
        return out.select("o_orderpriority", "n", "total")

    @query(f"agg_distinct_row{_n}", f"SELECT o_orderstatus, o_orderpriority FROM (SELECT DISTINCT {_k}o_orderstatus, o_orderpriority FROM {_ORDERS})")
    def agg_distinct_row(spark, sf_dir, compat=_compat):
        return M.distinct(_orders(spark, sf_dir), "o_orderstatus", "o_orderpriority", compat=compat)

    @query(f"agg_having{_n}", f"SELECT o_custkey % 100 AS k, count(*) AS n FROM {_ORDERS} GROUP BY {_k}o_custkey % 100 HAVING count(*) > {20 if _compat else 155}")
    def agg_having(spark, sf_dir, compat=_compat):
        df = _orders(spark, sf_dir).withColumn("k", F.col("o_custkey") % 100)
        return M.grouped(df, ["k"], F.count("*").alias("n"), compat=compat).where(F.col("n") > (20 if compat else 155)).select("k", "n")

    _top = f"SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {_ORDERS})"

    @query(f"topk{_n}", f"{_top} WHERE rn <= 25 ORDER BY shard, rn LIMIT 25" if _compat else "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    def topk(spark, sf_dir, compat=_compat):
        return M.top(_orders(spark, sf_dir), [F.desc("o_totalprice"), F.col("o_orderkey")], 25, compat=compat).select("o_orderkey", "o_totalprice")

    @query(f"offset{'_per_shard_compat' if _compat else ''}", f"{_top} WHERE rn > 10 AND rn <= 30 ORDER BY shard, rn LIMIT 20" if _compat else "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
    def offset(spark, sf_dir, compat=_compat):
        return M.top(_orders(spark, sf_dir), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 10, compat=compat).select("o_orderkey", "o_totalprice")

    @query(f"sort_order_by{_n}", f"SELECT o_orderkey, row_number() OVER (ORDER BY {_k}o_totalprice, o_orderkey) AS place FROM {_ORDERS}")
    def sort_order_by(spark, sf_dir, compat=_compat):
        df = _orders(spark, sf_dir).select("shard", "o_totalprice", "o_orderkey")
        order = [F.col(c) for c in ([*(["shard"] if compat else []), "o_totalprice", "o_orderkey"])]
        return M.number_rows(df, order).select("o_orderkey", "place")


@query("agg_expr_over_agg", "SELECT count(*) * 2 + 1 AS x, max(o_custkey) - min(o_custkey) AS spread FROM orders")
def agg_expr_over_agg(spark, sf_dir):
    out = M.scatter_gather(_orders(spark, sf_dir), {"n": ("count", F.lit(1)), "lo": ("min", F.col("o_custkey")), "hi": ("max", F.col("o_custkey"))})
    return out.select((F.col("n") * 2 + 1).alias("x"), (F.col("hi") - F.col("lo")).alias("spread"))


@query("agg_expr_over_agg_compat", f"SELECT arg_min(x, shard) AS x, sum(n)::BIGINT AS n FROM (SELECT shard, count(*) * 2 + 1 AS x, count(*) AS n FROM {_ORDERS} GROUP BY shard)")
def agg_expr_over_agg_compat(spark, sf_dir):
    """An expression over an aggregate isn't merged: the first shard's value stands beside merged ones."""
    per = _orders(spark, sf_dir).groupBy("shard").agg((F.count("*") * 2 + 1).alias("x"), F.count("*").alias("n"))
    return per.agg(F.min_by("x", "shard").alias("x"), F.sum("n").alias("n"))


@query("limit_merge", "SELECT 100::BIGINT AS n, 100::BIGINT AS keys, 100::BIGINT AS found")
def limit_merge(spark, sf_dir):
    """Any hundred rows of all shards: so many, none twice, each of them a row of the table."""
    some = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice").limit(100)
    there = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("there"))
    out = some.join(there, ["o_orderkey", "o_custkey", "o_totalprice"], "left")
    return out.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count("there").alias("found"))


@query("set_concat_shards", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def set_concat_shards(spark, sf_dir):
    path = work_folder(spark, "shards")
    R.write_sharded(table(spark, sf_dir, "orders"), CATALOG["orders"], path)
    # each part lists and reads its own shard's files only
    parts = M.concat_shards([R.read_sharded(spark, path, [s]) for s in range(8)])
    return parts.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("agg_approx_distinct", "SELECT count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem")
def agg_approx_distinct(spark, sf_dir):
    """The sketch is within four of its standard errors of the exact count."""
    df = table(spark, sf_dir, "lineitem")
    sketch = df.agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    exact = df.agg(F.count_distinct("l_partkey").alias("parts"))
    return sketch.join(exact).select("parts", (F.abs(F.col("about") - F.col("parts")) <= 0.08 * F.col("parts")).alias("near"))  # one row each
