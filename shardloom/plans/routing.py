"""Queries of sources, routing, filters, writes and the catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import hashing as H
from shardloom.functions.text import natural_key
from shardloom.operators import dml, routing as R
from shardloom.operators.catalog import CATALOG, Table, config_of, even, expand_slots, expand_tables, load_catalog, shard_map
from shardloom.operators.merge import concat_shards, number_rows
from shardloom.plans.registry import query, shard_sql, slot_sql
from shardloom.sources import tables as S

ORDERS, CUSTOMER, LINEITEM, EVENTS = (CATALOG[t] for t in ("orders", "customer", "lineitem", "events"))
_SUM = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _sharded(spark: SparkSession, sf_dir: str, name: str, dim: int = 0) -> DataFrame:
    return R.with_shard(S.table(spark, sf_dir, name), CATALOG[name], dim)


def _written(spark: SparkSession, sf_dir: str, name: str, dim: int = 0) -> str:
    path = S.work_folder(spark, f"sharded-{name}")
    R.write_sharded(S.table(spark, sf_dir, name), CATALOG[name], path, dim)
    return path


# sources and sinks


@query("src_shard_union", f"SELECT {shard_sql('o_custkey')} AS shard, count(*) AS n, {_SUM.format('o_totalprice')} AS total FROM orders GROUP BY 1")
def src_shard_union(spark, sf_dir):
    df = R.read_sharded(spark, _written(spark, sf_dir, "orders"))
    return df.groupBy("shard").agg(F.count("*").alias("n"), _money("o_totalprice").alias("total"))


@query("src_all_dims", f"SELECT 0 AS dim, {shard_sql('l_partkey')} AS shard, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 1, {shard_sql('l_suppkey')}, count(*) FROM lineitem GROUP BY 2")
def src_all_dims(spark, sf_dir):
    return concat_shards([_sharded(spark, sf_dir, "lineitem", d).groupBy(F.lit(d).alias("dim"), "shard").agg(F.count("*").alias("n")) for d in (0, 1)])


@query("src_jdbc", f"SELECT c_custkey % 2 AS shard, c_mktsegment, count(*) AS n, {_SUM.format('c_acctbal')} AS total FROM customer GROUP BY 1, 2")
def src_jdbc(spark, sf_dir):
    """Two databases with a half of a table each, read as shards; one of them by ranges too."""
    driver, name = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, S.work_folder(spark, "db").rsplit("/", 1)[1].replace("-", "")
    urls = {str(i): f"jdbc:derby:memory:{name}{i};create=true" for i in (0, 1)}
    customer = S.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    for i, url in urls.items():
        part = customer.where(F.col("c_custkey") % 2 == int(i)).coalesce(1)
        part.write.format("jdbc").options(url=url, dbtable="customer", createTableColumnTypes="c_mktsegment VARCHAR(40)", **driver).save()
    rows = S.jdbc_shards(spark, urls, 'SELECT * FROM customer', **driver)
    again = S.jdbc_ranges(spark, urls["0"], "customer", "c_custkey", 4, **driver)
    rows = rows.join(again.select("c_custkey", F.lit(True).alias("again")), "c_custkey", "left")
    rows = rows.where((F.col("shard") == "1") | F.col("again"))  # what the second reading lost isn't counted
    return rows.groupBy(F.col("shard").cast("long").alias("shard"), "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").cast("double").alias("total"))


@query("src_mapping", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 42, 99)")
def src_mapping(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 7, 42, 99)).select("o_orderkey", "o_custkey")


@query("src_mapping_table", f"SELECT {shard_sql('o_custkey')} AS shard, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1")
def src_mapping_table(spark, sf_dir):
    """A mapping table, itself sharded by its key, is read to find the shards of the rows wanted."""
    mapping = Table("mapping", [even("o_orderkey", "mapping")])
    path = S.work_folder(spark, "mapping")
    R.write_sharded(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mapping, path)
    wanted = R.read_sharded(spark, path).where("o_orderkey % 7 = 0").select("o_custkey")
    return R.with_shard(wanted, ORDERS).groupBy("shard").agg(F.count("*").alias("n"))


@query("src_config", "SELECT 'orders' AS name, range AS slot, (range // 128)::INTEGER AS shard, 'orders_' || (range // 128) AS physical_table, CASE WHEN range < 512 THEN 'shard1db' ELSE 'shard2db' END AS db FROM range(1024)")
def src_config(spark, sf_dir):
    """The catalog is written as configuration files, a table each, and loaded from them."""
    path = S.work_folder(spark, "catalog")
    for n, t in CATALOG.items():
        spark.createDataFrame([(json.dumps(config_of({n: t})),)], "value string").coalesce(1).write.mode("append").text(path)
    rows = shard_map(spark, load_catalog(spark, path)).where("table = 'orders'")
    return rows.select(F.col("table").alias("name"), F.col("slot").cast("long").alias("slot"), "shard", "physical_table", F.col("database").alias("db"))


@query("src_config_files", "SELECT * FROM (VALUES ('a', 8), ('b', 16)) t(grp, shards)")
def src_config_files(spark, sf_dir):
    path = S.work_folder(spark, "config")
    for row in (("a", 8), ("b", 16)):
        spark.createDataFrame([row], "grp string, shards int").coalesce(1).write.mode("append").json(path)
    return S.read_config(spark, path).select("grp", F.col("shards").cast("int").alias("shards"))


@query("src_kvfile", "SELECT * FROM (VALUES ('master', 'db1 3306'), ('slave', 'db2 3306')) t(name, setting)")
def src_kvfile(spark, sf_dir):
    path = S.work_folder(spark, "kv")
    spark.createDataFrame([("# list",), ("master   db1 3306",), ("",), ("slave db2 3306",)], "value string").coalesce(1).write.text(path)
    return S.read_key_values(spark, path)


for _kind in ("parquet", "orc", "json", "csv"):

    @query(f"io_{_kind}", f"SELECT c_mktsegment, count(*) AS n, {_SUM.format('c_acctbal')} AS total FROM customer GROUP BY 1")
    def io(spark, sf_dir, kind=_kind):
        df = S.round_trip(S.table(spark, sf_dir, "customer"), kind, S.work_folder(spark, kind))
        return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), _money("c_acctbal").alias("total"))


@query("snk_mq", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS message FROM events WHERE event_id % 10 = 0")
def snk_mq(spark, sf_dir):
    df = S.table(spark, sf_dir, "events").where("event_id % 10 = 0").select("event_id", "event_type")
    return df.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("message"))


@query("snk_sqllog", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def snk_sqllog(spark, sf_dir):
    path = S.work_folder(spark, "log")
    S.table(spark, sf_dir, "events").select(S.log_line("event_id", "user_id", "event_type").alias("value")).write.text(path)
    pattern = r"^(\d+) => (\d+) => (\w+)$"
    back = spark.read.text(path).select(F.regexp_extract("value", pattern, 2).cast("long").alias("user_id"), F.regexp_extract("value", pattern, 3).alias("event_type"))
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("snk_patternfile", "SELECT md5(event_type) || '#' || event_type AS line FROM (SELECT DISTINCT event_type FROM events)")
def snk_patternfile(spark, sf_dir):
    path = S.work_folder(spark, "patterns")
    df = S.table(spark, sf_dir, "events").select("event_type").distinct()
    df.select(F.concat(F.md5("event_type"), F.lit("#"), "event_type").alias("value")).sortWithinPartitions("value").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# routing


@query("route_hash", f"SELECT o_orderkey, {slot_sql('o_custkey')} AS slot, {shard_sql('o_custkey')} AS shard FROM orders")
def route_hash(spark, sf_dir):
    return _sharded(spark, sf_dir, "orders").select("o_orderkey", "slot", "shard")


@query("route_hash_text", f"SELECT c_custkey, {slot_sql('c_name')} AS slot FROM customer")
def route_hash_text(spark, sf_dir):
    return S.table(spark, sf_dir, "customer").select("c_custkey", H.slot(F.col("c_name")).alias("slot"))


@query("route_long_keys", f"SELECT c_name, {shard_sql('c_name')} AS shard, 1::BIGINT AS found FROM customer WHERE c_custkey % 20 = 0")
def route_long_keys(spark, sf_dir):
    """Names of 18 characters: each is found in the shard that its literal routes to."""
    named, path = Table("customer", [even("c_name", "customer_name")]), S.work_folder(spark, "names")
    R.write_sharded(S.table(spark, sf_dir, "customer"), named, path)
    keys = R.with_shard(S.table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select("c_name"), named).drop("slot")
    rows = spark.read.parquet(path).select("c_name", "shard")
    found = keys.join(rows.withColumn("one", F.lit(1)), ["c_name", "shard"], "left")
    return found.groupBy("c_name", "shard").agg(F.count("one").alias("found"))


@query("route_hash_golden", "SELECT * FROM (VALUES ('12345', 51), ('346', 501), ('123456789', 53), ('987654321', 821), ('9999', 576), ('abc''''dfhj', 198), ('', 0), (NULL, -1)) t(key_text, slot)")
def route_hash_golden(spark, sf_dir):
    keys = ["12345", "346", "123456789", "987654321", "9999", "abc''dfhj", "", None]
    return spark.createDataFrame([(k,) for k in keys], "key_text string").select("key_text", H.slot(F.col("key_text")).alias("slot"))


@query("route_multicol_hash", f"SELECT l_orderkey, l_linenumber, {slot_sql('l_partkey * l_suppkey')} AS slot FROM lineitem")
def route_multicol_hash(spark, sf_dir):
    df = S.table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", H.slot_of_keys(F.col("l_partkey"), F.col("l_suppkey")).alias("slot"))


@query("route_composed", f"SELECT (o_orderkey * 1024 + {slot_sql('o_custkey')})::BIGINT AS order_id, {slot_sql('o_custkey')} AS slot, {shard_sql('o_custkey')} AS shard FROM orders")
def route_composed(spark, sf_dir):
    df = S.table(spark, sf_dir, "orders").select(H.encode_composed(F.col("o_orderkey"), H.slot_of_integer(F.col("o_custkey"))).alias("order_id"))
    return df.withColumn("slot", H.decode_composed(F.col("order_id"))).withColumn("shard", ORDERS.dimensions[0].shard_column(F.col("slot")))


@query("route_two_dim", f"SELECT event_id, lower(left(event_id::VARCHAR, 27) || lpad(printf('%X', {slot_sql('user_id')} * 1024 + {slot_sql('event_id')}), 5, '0')) AS id, {slot_sql('user_id')} AS d1, {slot_sql('event_id')} AS d2 FROM events")
def route_two_dim(spark, sf_dir):
    df = S.table(spark, sf_dir, "events")
    df = df.select("event_id", H.encode_two_dim(F.col("event_id"), H.slot_of_integer(F.col("user_id")), H.slot_of_integer(F.col("event_id"))).alias("id"))
    return df.withColumn("d1", H.decode_two_dim(F.col("id"), 0)).withColumn("d2", H.decode_two_dim(F.col("id"), 1))


@query("route_index", f"SELECT o_orderkey, o_custkey FROM orders WHERE {shard_sql('o_custkey')} = 3")
def route_index(spark, sf_dir):
    kind, values = R.choose_route(ORDERS, {}, shard_index=3)
    return R.read_sharded(spark, _written(spark, sf_dir, "orders"), R.shards_of(ORDERS, kind, values)).select("o_orderkey", "o_custkey")


@query("route_mapping", "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (5, 77, 123))")
def route_mapping(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders")
    mapping = orders.select("o_orderkey", "o_custkey")
    return R.mapping_lookup(orders, mapping, F.col("o_orderkey").isin(5, 77, 123), "o_custkey").select("o_orderkey", "o_custkey")


@query("route_mapping_multi", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (1, 2, 3, 4, 5) AND l_suppkey IN (1, 2, 3, 4, 5, 6, 7)")
def route_mapping_multi(spark, sf_dir):
    keys = spark.createDataFrame([(p, s) for p in range(1, 6) for s in range(1, 8)], "l_partkey long, l_suppkey long")
    return S.table(spark, sf_dir, "lineitem").join(keys, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("route_mapping_threshold", "SELECT * FROM (VALUES (3, 'mapping'), (7, 'mapping'), (8, 'all'), (50, 'all')) t(n_values, kind)")
def route_mapping_threshold(spark, sf_dir):
    return spark.createDataFrame([(n, R.choose_route(ORDERS, {"o_orderkey": list(range(n))})[0]) for n in (3, 7, 8, 50)], "n_values int, kind string")


@query("route_last", "SELECT o_orderkey, o_custkey FROM orders WHERE false")
def route_last(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders")
    return R.mapping_lookup(orders, orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == -1, "o_custkey").select("o_orderkey", "o_custkey")


@query("route_all", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def route_all(spark, sf_dir):
    kind, values = R.choose_route(ORDERS, {})
    df = R.read_sharded(spark, _written(spark, sf_dir, "orders"), R.shards_of(ORDERS, kind, values))
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("route_in_list", f"SELECT o_orderkey, o_custkey, {shard_sql('o_custkey')} AS shard FROM orders WHERE o_custkey IN (7, 11, 13, 100)")
def route_in_list(spark, sf_dir):
    keys = [7, 11, 13, 100]
    shards = R.shards_of(ORDERS, *R.choose_route(ORDERS, {"o_custkey": keys}))
    return R.read_sharded(spark, _written(spark, sf_dir, "orders"), shards).where(F.col("o_custkey").isin(keys)).select("o_orderkey", "o_custkey", "shard")


@query("route_in_prune", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey BETWEEN 1 AND 300 GROUP BY 1")
def route_in_prune(spark, sf_dir):
    keys = spark.range(1, 301).select(F.col("id").alias("o_custkey"))
    return R.by_keys(S.table(spark, sf_dir, "orders"), keys, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("route_select_priority", "SELECT * FROM (VALUES ('index', 'index'), ('composed and key', 'composed'), ('key and mapping', 'key'), ('mapping', 'mapping'), ('none', 'all')) t(given, kind)")
def route_select_priority(spark, sf_dir):
    cases = [("index", {"o_custkey": [1]}, 2), ("composed and key", {"order_id": [1024], "o_custkey": [1]}, None), ("key and mapping", {"o_custkey": [1], "o_orderkey": [2]}, None), ("mapping", {"o_orderkey": [2]}, None), ("none", {}, None)]
    return spark.createDataFrame([(n, R.choose_route(ORDERS, e, shard_index=i)[0]) for n, e, i in cases], "given string, kind string")


@query("route_dml_priority", "SELECT * FROM (VALUES ('key', 'key'), ('mapping', 'mapping'), ('one of two keys', 'ERR_KEY_IS_NOT_COMPOSED'), ('none', 'ERR_NO_COMPOSED_ID')) t(given, outcome)")
def route_dml_priority(spark, sf_dir):
    cases = [("key", ORDERS, {"o_custkey": [1]}), ("mapping", ORDERS, {"o_orderkey": [2]}), ("one of two keys", LINEITEM, {"l_partkey": [1]}), ("none", ORDERS, {})]

    def outcome(table, equal):
        try:
            return R.choose_route(table, equal, strict=True)[0]
        except ValueError as e:
            return e.code

    return spark.createDataFrame([(n, outcome(t, e)) for n, t, e in cases], "given string, outcome string")


@query("route_single_id_check", f"SELECT o_custkey % 50 AS batch, count(DISTINCT {slot_sql('o_custkey')}) AS slots, count(DISTINCT {slot_sql('o_custkey')}) = 1 AS allowed FROM orders GROUP BY 1")
def route_single_id_check(spark, sf_dir):
    df = _sharded(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("batch")).agg(F.count_distinct("slot").alias("slots"))
    return df.withColumn("allowed", F.col("slots") == 1)


@query("route_shard_info", f"SELECT v AS value, {slot_sql('v')} AS slot, {shard_sql('v')} AS shard, 'orders_' || {shard_sql('v')} AS physical_table, CASE WHEN {shard_sql('v')} < 4 THEN 'shard1db' ELSE 'shard2db' END AS database FROM (VALUES ('12345'), ('346'), ('9999')) t(v)")
def route_shard_info(spark, sf_dir):
    return R.shard_info(spark, "orders", "o_custkey", [12345, 346, 9999])


@query("route_dbrole", "SELECT * FROM (VALUES ('SELECT', false, false, 'slave'), ('SELECT', true, false, 'master'), ('SELECT', false, true, 'master'), ('UPDATE', false, false, 'master')) t(kind, in_tx, forced, role)")
def route_dbrole(spark, sf_dir):
    rows = [("SELECT", False, False), ("SELECT", True, False), ("SELECT", False, True), ("UPDATE", False, False)]
    return spark.createDataFrame([(*r, R.role_of(*r)) for r in rows], "kind string, in_tx boolean, forced boolean, role string")


# filters


@query("filt_alias", "SELECT o_custkey AS cust, count(*) AS n FROM orders WHERE o_custkey IN (3, 4, 5) GROUP BY 1")
def filt_alias(spark, sf_dir):
    df = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"))
    return df.where(F.col("cust").isin(3, 4, 5)).groupBy("cust").agg(F.count("*").alias("n"))


@query("filt_dup_col", "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 4, 5) AND o_custkey IN (4, 5, 6)")
def filt_dup_col(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").where(F.col("o_custkey").isin(3, 4, 5) & F.col("o_custkey").isin(4, 5, 6)).select("o_orderkey")


@query("filt_bind_master", "SELECT count(*) AS n, 'master' AS role FROM orders WHERE 'bind_master' = 'bind_master' AND o_custkey < 100")
def filt_bind_master(spark, sf_dir):
    df = S.table(spark, sf_dir, "orders").where((F.lit("bind_master") == "bind_master") & (F.col("o_custkey") < 100))
    return df.agg(F.count("*").alias("n")).withColumn("role", F.lit(R.role_of("SELECT", force_master=True)))


@query("filt_rebalance", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01 00:00:00' AND (o_custkey < 50 OR o_orderstatus = 'F')")
def filt_rebalance(spark, sf_dir):
    where = (F.col("o_custkey") < 50) | (F.col("o_orderstatus") == "F")
    return S.table(spark, sf_dir, "orders").where(dml.rebalance_filter(where, "o_orderdate", "1995-01-01 00:00:00")).select("o_orderkey")


@query("filt_tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN ((1, 1), (2, 3), (10, 7))")
def filt_tuple_in(spark, sf_dir):
    keys = [F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ((1, 1), (2, 3), (10, 7))]
    return S.table(spark, sf_dir, "lineitem").where(F.struct("l_partkey", "l_suppkey").isin(*keys)).select("l_orderkey", "l_linenumber")


# the one native join and the comparison of dimensions


@query("join_mapping_lookup", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey % 100 = 1")
def join_mapping_lookup(spark, sf_dir):
    mapping = S.table(spark, sf_dir, "customer").select("c_name", "c_custkey").where("c_custkey % 100 = 1")
    one = mapping.groupBy("c_name").agg(F.min("c_custkey").alias("o_custkey"))
    return one.join(S.table(spark, sf_dir, "orders"), "o_custkey").select("c_name", "o_orderkey")


@query("join_two_dim_compare", "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'missing_in_second' ELSE 'different' END AS state FROM events WHERE event_id % 97 = 0 OR event_id % 101 = 0")
def join_two_dim_compare(spark, sf_dir):
    one = S.table(spark, sf_dir, "events").select("event_id", "value")
    two = one.where("event_id % 97 <> 0").withColumn("value", F.when(F.col("event_id") % 101 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return dml.compare_dimensions(one, two, "event_id", "value")


# writes


@query("dml_insert_route", f"SELECT {shard_sql('c_custkey')} AS shard, count(*) AS n FROM customer GROUP BY 1")
def dml_insert_route(spark, sf_dir):
    path = S.work_folder(spark, "insert")
    df = S.table(spark, sf_dir, "customer")
    dml.insert(df.where("c_custkey % 2 = 0"), CUSTOMER, path)
    dml.insert(df.where("c_custkey % 2 = 1"), CUSTOMER, path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"))


@query("dml_insert_two_keys", f"SELECT 'user' AS dim, {shard_sql('user_id')} AS shard, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'event', {shard_sql('event_id')}, count(*) FROM events GROUP BY 2")
def dml_insert_two_keys(spark, sf_dir):
    out = []
    for d, name in enumerate(("user", "event")):
        path = _written(spark, sf_dir, "events", d)
        out.append(spark.read.parquet(path).groupBy(F.lit(name).alias("dim"), "shard").agg(F.count("*").alias("n")))
    return concat_shards(out)


@query("dml_insert_multirow_check", "SELECT * FROM (VALUES ('one key', 'inserted'), ('all keys', 'ERR_SQL_SYNTAX_ERROR')) t(given, outcome)")
def dml_insert_multirow_check(spark, sf_dir):
    df, path = S.table(spark, sf_dir, "orders"), S.work_folder(spark, "multirow")

    def outcome(rows):
        try:
            dml.insert(rows, ORDERS, path, single=True)
            return "inserted"
        except ValueError as e:
            return e.code

    return spark.createDataFrame([("one key", outcome(df.where("o_custkey = 7"))), ("all keys", outcome(df))], "given string, outcome string")


@query("dml_insert_hash_check", f"SELECT o_orderkey, ({slot_sql('o_custkey')} + 1) % 1024 AS id_slot, {slot_sql('o_custkey')} AS key_slot FROM orders WHERE o_orderkey % 50 = 0")
def dml_insert_hash_check(spark, sf_dir):
    key = H.slot_of_integer(F.col("o_custkey"))
    off = F.when(F.col("o_orderkey") % 50 == 0, (key + 1) % 1024).otherwise(key)
    df = S.table(spark, sf_dir, "orders").withColumn("order_id", H.encode_composed(F.col("o_orderkey"), off))
    return dml.hash_check(df, "order_id", key).select("o_orderkey", "id_slot", "key_slot")


@query("dml_insert_mapping", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 2000 ELSE o_custkey END AS o_custkey FROM orders")
def dml_insert_mapping(spark, sf_dir):
    mapping = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    some = mapping.where("o_orderkey % 10 = 0")
    changes = some.selectExpr("o_orderkey", "o_custkey + 1000 AS o_custkey", "1 AS seq").union(some.selectExpr("o_orderkey", "o_custkey + 2000 AS o_custkey", "2 AS seq"))
    return dml.upsert_mapping(mapping, changes, "o_orderkey", "seq")


@query("dml_update", f"SELECT o_orderstatus, count(*) AS n, {_SUM.format('p')} AS total FROM (SELECT CASE WHEN o_custkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders) GROUP BY 1")
def dml_update(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    shard = R.single_shard(ORDERS, *R.choose_route(ORDERS, {"o_custkey": [7]}, strict=True))
    dml.update_rows(spark, path, [shard], F.col("o_custkey") == 7, {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), _money("o_totalprice").alias("total"))


@query("dml_delete", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_custkey <> 7")
def dml_delete(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    shard = R.single_shard(ORDERS, *R.choose_route(ORDERS, {"o_custkey": [7]}, strict=True))
    dml.delete_rows(spark, path, [shard], F.col("o_custkey") == 7)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("dml_delete_whole_shard", f"SELECT {shard_sql('o_custkey')} AS shard, count(*) AS n FROM orders WHERE {shard_sql('o_custkey')} <> 5 GROUP BY 1")
def dml_delete_whole_shard(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    dml.delete_rows(spark, path, [5], F.col("o_orderkey").isNotNull())
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"))


@query("dml_update_key_watch", "SELECT * FROM (VALUES ('status', ''), ('key', 'o_custkey'), ('id and key', 'o_custkey,order_id')) t(given, watched)")
def dml_update_key_watch(spark, sf_dir):
    cases = [("status", ["o_orderstatus"]), ("key", ["o_custkey", "o_orderstatus"]), ("id and key", ["order_id", "o_custkey"])]
    return spark.createDataFrame([(n, ",".join(dml.watched_columns(ORDERS, c))) for n, c in cases], "given string, watched string")


@query("dml_no_where_guard", "SELECT * FROM (VALUES ('update', 'ERR_SQL_SYNTAX_ERROR'), ('delete', 'ERR_SQL_SYNTAX_ERROR')) t(statement, code)")
def dml_no_where_guard(spark, sf_dir):
    rows = []
    for name, f in (("update", lambda: dml.update(spark, "", [0], None, {})), ("delete", lambda: dml.delete(spark, "", [0], None))):
        try:
            f()
        except ValueError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "statement string, code string")


@query("dml_truncate", f"SELECT count(*) AS n FROM orders WHERE {shard_sql('o_custkey')} <> 2")
def dml_truncate(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    dml.truncate(spark, path, ORDERS, [2])
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("dml_batch_truncate", "SELECT unnest(range(8))::INTEGER AS shard, 0::BIGINT AS left_over")
def dml_batch_truncate(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    emptied = dml.truncate(spark, path, ORDERS)
    left = spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in emptied], "shard int").join(left, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("left_over"))


@query("dml_batch_insert", f"SELECT {shard_sql('l_partkey')} AS shard, count(*) AS n FROM lineitem GROUP BY 1")
def dml_batch_insert(spark, sf_dir):
    return spark.read.parquet(_written(spark, sf_dir, "lineitem")).groupBy("shard").agg(F.count("*").alias("n"))


@query("dml_batch_delete", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)")
def dml_batch_delete(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    dml.delete_keys(spark, path, ORDERS, spark.range(1, 11).select(F.col("id").alias("o_custkey")))
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("dml_dual_write_verify", "SELECT CASE event_id % 97 WHEN 5 THEN 'missing_in_second' ELSE 'different' END AS state, count(*) AS n FROM events WHERE event_id % 97 IN (5, 6) GROUP BY 1")
def dml_dual_write_verify(spark, sf_dir):
    """Both dimensions of one table, the second one with rows lost and rows changed."""
    paths = [_written(spark, sf_dir, "events", d) for d in (0, 1)]
    every = list(range(8))
    dml.update_rows(spark, paths[1], every, F.col("event_id") % 97 == 6, {"value": F.col("value") + 1})
    dml.delete_rows(spark, paths[1], every, F.col("event_id") % 97 == 5)
    one, two = (spark.read.parquet(p) for p in paths)
    return dml.compare_dimensions(one, two, "event_id", "user_id", "event_type", "value").groupBy("state").agg(F.count("*").alias("n"))


@query("dml_affected_rows", f"SELECT count(*)::BIGINT AS affected, 0::BIGINT AS warnings FROM orders WHERE o_orderstatus = 'F'")
def dml_affected_rows(spark, sf_dir):
    path = _written(spark, sf_dir, "orders")
    return dml.affected(dml.update_rows(spark, path, list(range(8)), F.col("o_orderstatus") == "F", {"o_orderstatus": F.lit("X")}))


# catalog


@query("cat_sharded_tables", "SELECT 'events_user_' || range AS physical_table, range::INTEGER AS place FROM range(8)")
def cat_sharded_tables(spark, sf_dir):
    rows = shard_map(spark).where("table = 'events' and dim = 0").select("physical_table", F.col("shard").alias("place")).distinct()
    return rows


@query("cat_sharding_count", "SELECT * FROM (VALUES ('orders', 0, 8), ('customer', 0, 8), ('lineitem', 0, 8), ('lineitem', 1, 8), ('events', 0, 8), ('events', 1, 8)) t(name, dim, shards)")
def cat_sharding_count(spark, sf_dir):
    return shard_map(spark).groupBy(F.col("table").alias("name"), "dim").agg(F.count_distinct("physical_table").cast("int").alias("shards"))


@query("cat_db_config", "SELECT '{\"database\":\"' || d || '\",\"slots\":' || n || '}' AS config FROM (VALUES ('shard1db', 512), ('shard2db', 512)) t(d, n)")
def cat_db_config(spark, sf_dir):
    rows = shard_map(spark).where("table = 'orders'").groupBy("database").agg(F.count("*").alias("slots"))
    return rows.select(F.to_json(F.struct("database", "slots")).alias("config"))


@query("set_tables_visible", "SELECT unnest(['orders', 'customer', 'lineitem', 'events', 'region', 'nation']) AS name")
def set_tables_visible(spark, sf_dir):
    m = shard_map(spark)
    physical = m.select(F.col("physical_table").alias("name")).union(spark.createDataFrame([("region",), ("nation",)], "name string"))
    logical = m.select(F.col("table").alias("name"))
    return physical.union(logical).distinct().join(m.select(F.col("physical_table").alias("name")), "name", "left_anti")


@query("fn_route_expand", "SELECT unnest(['t_0', 't_1', 't_2', 't_3', 't_7', 't_9', 't_11', 't_13', 't_15']) AS name")
def fn_route_expand(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in expand_tables("t_[0-3,7,9-15-2]")], "name string")


@query("fn_slot_ranges", "SELECT unnest([0, 1, 2, 3, 4, 8]) AS slot")
def fn_slot_ranges(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in expand_slots("0-1,2-4,8")], "slot int")


@query("fn_lcp", "SELECT 'lineitem' AS name, 0 AS dim, 'lineitem_part_' AS prefix UNION ALL SELECT 'lineitem', 1, 'lineitem_supp_'")
def fn_lcp(spark, sf_dir):
    return spark.createDataFrame([("lineitem", i, d.prefix) for i, d in enumerate(LINEITEM.dimensions)], "name string, dim int, prefix string")


@query("sort_natural", f"SELECT name, row_number() OVER (ORDER BY k) AS place FROM (SELECT o_orderkey AS k, 'order_' || o_orderkey || '_x' AS name FROM orders UNION ALL SELECT 10 ** 12 + n, 'order_{'9' * 24}' || n || '_x' FROM (VALUES (1), (2), (3)) t(n))")
def sort_natural(spark, sf_dir):
    names = S.table(spark, sf_dir, "orders").select(F.concat(F.lit("order_"), "o_orderkey", F.lit("_x")).alias("name"))
    long = spark.createDataFrame([(f"order_{'9' * 24}{n}_x",) for n in (1, 2, 3)], "name string")
    return number_rows(names.union(long), [natural_key(F.col("name")), F.length("name"), F.col("name")])


@query("sort_natural_golden", "SELECT * FROM (VALUES ('a1', 1), ('a2', 2), ('a02', 3), ('a10', 4), ('b', 5), ('b1c2', 6), ('b1c10', 7)) t(name, place)")
def sort_natural_golden(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("b1c10", "a10", "b", "a02", "a1", "b1c2", "a2")], "name string")
    return number_rows(df, [natural_key(F.col("name")), F.length("name"), F.col("name")])


@query("filt_func_in", "SELECT o_orderkey FROM orders WHERE upper(o_orderstatus) IN ('F', 'P') AND abs(o_custkey) IN (1, 2, 3, 4)")
def filt_func_in(spark, sf_dir):
    df = S.table(spark, sf_dir, "orders")
    return df.where(F.upper("o_orderstatus").isin("F", "P") & F.abs("o_custkey").isin(1, 2, 3, 4)).select("o_orderkey")


@query("filt_literal_quote", "SELECT o_orderkey FROM orders WHERE \"o_custkey\" = 7")
def filt_literal_quote(spark, sf_dir):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE `o_custkey` = 7", orders=S.table(spark, sf_dir, "orders"))


@query("cat_help", "SELECT unnest(['by_keys', 'choose_route', 'java_hash', 'mapping_lookup', 'read_sharded', 'role_of', 'shard_info', 'shards_of', 'single_shard', 'slot_of', 'slot_of_all', 'two_dim_slots', 'with_shard', 'write_sharded']) AS name, true AS told")
def cat_help(spark, sf_dir):
    """The routing functions and whether they have a line of help."""
    rows = [(n, bool(f.__doc__)) for n, f in vars(R).items() if callable(f) and getattr(f, "__module__", "") == R.__name__ and not n.startswith("_")]
    return spark.createDataFrame(rows, "name string, told boolean")


@query("cat_result_cache", "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 2), (4, 3), (5, 4)) t(call, built)")
def cat_result_cache(spark, sf_dir):
    """Calls of a cache of one entry and 30 seconds: again, another text, the first one, and after its time."""
    now, built, out = 0.0, 0, []
    cache = S.ResultCache(entries=1, seconds=30, clock=lambda: now)

    def build():
        nonlocal built
        built += 1
        return spark.range(3)

    for call, (at, text) in enumerate([(0, "a"), (29, "a"), (29, "b"), (30, "a"), (61, "a")], 1):
        now = float(at)
        assert cache.get(text, build).count() == 3
        out.append((call, built))
    cache.clear()
    return spark.createDataFrame(out, "call int, built int")


@query("cat_show_tables", "SELECT unnest(['customer', 'events', 'lineitem', 'orders']) AS name, unnest([1, 2, 2, 1]) AS dims, unnest(['c_custkey', 'user_id;event_id', 'l_partkey;l_suppkey', 'o_custkey']) AS keys")
def cat_show_tables(spark, sf_dir):
    rows = [(t.name, len(t.dimensions), ";".join(",".join(d.columns) for d in t.dimensions)) for t in CATALOG.values()]
    return spark.createDataFrame(rows, "name string, dims int, keys string")


@query("cat_show_columns", "SELECT column_name AS name, row_number() OVER () - 1 AS place FROM (DESCRIBE SELECT * FROM orders)")
def cat_show_columns(spark, sf_dir):
    fields = S.table(spark, sf_dir, "orders").schema.names
    return spark.createDataFrame([(n, i) for i, n in enumerate(fields)], "name string, place long")


@query("dml_insert_select", f"SELECT {shard_sql('c_custkey')} AS shard, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def dml_insert_select(spark, sf_dir):
    path = S.work_folder(spark, "insert-select")
    dml.insert(S.table(spark, sf_dir, "customer").where("c_acctbal > 0"), CUSTOMER, path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"))


@query("dml_replace", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_replace(spark, sf_dir):
    old = S.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 7 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(1).alias("seq"))
    return dml.upsert_mapping(old, new, "c_custkey", "seq")


@query("route_table_union_all_dims", f"SELECT {shard_sql('user_id')} AS user_shard, {shard_sql('event_id')} AS event_shard, count(*) AS n FROM events GROUP BY 1, 2")
def route_table_union_all_dims(spark, sf_dir):
    df = _sharded(spark, sf_dir, "events", 0).withColumnRenamed("shard", "user_shard").drop("slot")
    return R.with_shard(df, EVENTS, 1).groupBy("user_shard", F.col("shard").alias("event_shard")).agg(F.count("*").alias("n"))
