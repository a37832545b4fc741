"""Queries of global ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import hashing as H
from shardloom.operators import sequences as Q
from shardloom.plans.registry import query, slot_sql
from shardloom.sources.tables import table, work_folder

# the block that a request opens depends on all before it: a recursion over each sequence's requests
_ALLOC = """
WITH RECURSIVE r AS (SELECT 'seq' || (o_custkey % 5) AS seq, o_orderkey AS req_no, 1 + o_orderkey % 7 AS n,
                            row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS i FROM orders),
a AS (SELECT seq, 0 AS i, 0::BIGINT AS req_no, 0::BIGINT AS n, 0::BIGINT AS base, 0::BIGINT AS used FROM (SELECT DISTINCT seq FROM r)
  UNION ALL
  SELECT a.seq, r.i, r.req_no, r.n, CASE WHEN a.used + r.n > 100 THEN a.base + 100 ELSE a.base END, CASE WHEN a.used + r.n > 100 THEN r.n ELSE a.used + r.n END
  FROM a JOIN r ON r.seq = a.seq AND r.i = a.i + 1)
SELECT seq, req_no, n, base + used - n + 1 AS begin_id, base + used AS end_id FROM a WHERE i > 0
"""


def _requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("seq"), F.col("o_custkey") % 5).alias("seq"), F.col("o_orderkey").alias("req_no"), (1 + F.col("o_orderkey") % 7).alias("n"))


@query("seq_range_alloc", _ALLOC)
def seq_range_alloc(spark, sf_dir):
    return Q.allocate(_requests(spark, sf_dir), block=100)


@query("seq_range_alloc_golden", "SELECT * FROM (VALUES (1, 101, 110), (2, 111, 120), (3, 201, 300)) t(req_no, begin_id, end_id)")
def seq_range_alloc_golden(spark, sf_dir):
    df = spark.createDataFrame([("s", 1, 10), ("s", 2, 10), ("s", 3, 100)], "seq string, req_no long, n long")
    return Q.allocate(df, block=100, base=100).select("req_no", "begin_id", "end_id")


@query("seq_expand", f"SELECT seq, unnest(range(begin_id, end_id + 1)) AS id FROM ({_ALLOC})")
def seq_expand(spark, sf_dir):
    return Q.expand(Q.allocate(_requests(spark, sf_dir), block=100)).select("seq", "id")


@query("seq_count_check", "SELECT * FROM (VALUES (0, false), (1, true), (100, true), (101, false)) t(n, granted)")
def seq_count_check(spark, sf_dir):
    df = spark.createDataFrame([(f"s{n}", 1, n) for n in (0, 1, 100, 101)], "seq string, req_no long, n long")
    return Q.allocate(df, block=100).select("n", F.col("begin_id").isNotNull().alias("granted"))


@query("seq_recycle", "SELECT range * 100 AS last, CASE WHEN range * 100 + 100 > 950 THEN 1 ELSE range * 100 + 100 END AS next FROM range(11)")
def seq_recycle(spark, sf_dir):
    return spark.range(11).select((F.col("id") * 100).alias("last"), Q.recycle(F.col("id") * 100, 100, 1, 950).cast("long").alias("next"))


@query("seq_zone", "SELECT 'order_seq' AS seq, 1 AS lo, 1000 AS hi")
def seq_zone(spark, sf_dir):
    zones = spark.createDataFrame([("order_seq", "a", True, 1, 1000), ("order_seq", "b", True, 1001, 2000), ("old_seq", "a", False, 1, 9)], "seq string, zone string, in_use boolean, lo int, hi int")
    return Q.active_zones(zones, "a").select("seq", "lo", "hi")


@query("seq_composed", f"SELECT c_custkey, ((100 + c_custkey) * 1024 + {slot_sql('c_custkey')})::BIGINT AS id FROM customer")
def seq_composed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", Q.composed_ids(100 + F.col("c_custkey"), H.slot_of_integer(F.col("c_custkey"))).alias("id"))


@query("seq_common", "SELECT o_orderkey, 5000 + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS id FROM orders")
def seq_common(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (5000 + F.row_number().over(w)).cast("long").alias("id"))


@query("seq_fix_hash", f"SELECT '26383326abc' || lower(lpad(printf('%X', {slot_sql('123')} * 1024 + {slot_sql('456')}), 5, '0')) AS id")
def seq_fix_hash(spark, sf_dir):
    return spark.range(1).select(H.encode_two_dim(F.lit("26383326abc"), H.slot(F.lit("123")), H.slot(F.lit("456"))).alias("id"))


@query("seq_refill", "SELECT * FROM (VALUES (1, 'a', 100), (2, 'a', 200), (3, 'b', 910), (4, 'b', 1), (5, 'a', 300)) t(call, seq, base)")
def seq_refill(spark, sf_dir):
    path = f"{work_folder(spark, 'allocator')}/seqs"
    Q.start_allocator(spark.createDataFrame([("a", 0, 100, 1, 10_000), ("b", 900, 10, 1, 915)], Q.ALLOCATOR), path)
    return spark.createDataFrame([(i + 1, s, Q.refill(spark, path, s)) for i, s in enumerate("aabba")], "call int, seq string, base long")
