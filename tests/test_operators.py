"""Known values, refusals and odd inputs of the library's operators."""

import pytest
from pyspark.sql import functions as F

from shardloom.functions import hashing as H
from shardloom.functions import text as X
from shardloom.operators import dml, merge, sequences, telemetry
from shardloom.operators import routing as R
from shardloom.operators.catalog import CATALOG, Dimension, ShardError, Table, even, expand_slots, expand_tables, natural
from shardloom.plans import QUERIES
from shardloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_slots(spark):
    keys = ["12345", "346", "123456789", "987654321", "9999", "abc''dfhj", "", "\U0001f602''中文", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", H.slot(F.col("k")).alias("s"))
    got = {r.k: r.s for r in df.collect()}
    assert [got[k] for k in keys[:6]] == [51, 501, 53, 821, 576, 198] and got[""] == 0 and got["\U0001f602''中文"] == 191
    assert all(got[k] == R.slot_of(k) for k in keys)


def test_slots_of_integers_are_slots(spark):
    keys = [0, 7, -7, 10**11, 10**12 - 1, 10**12, -(10**11), 1234567890123456789, 2**63 - 1, -(2**63), -(2**63) + 1, None] + [int(str(k) * 3) for k in range(100000, 100400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", H.slot(F.col("k")).alias("a"), H.slot_of_integer(F.col("k")).alias("b"))
    assert all(r.a == r.b == R.slot_of(r.k) for r in df.collect())


def test_products_of_keys_wrap(spark):
    pairs = [(3, 4), (2**62, 3), (2**63 - 1, 2**63 - 1), (-(2**63), 1), (-(2**63), 3), (-5, 7), (10**18, 10**18)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", H.slot_of_keys(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == R.slot_of_all((r.a, r.b)) for r in df.collect()) and R.slot_of_all(("x", 2)) == R.slot_of(R.slot_of("x") * 2)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_what_is_written_is_found(spark, tmp_path, kind):
    """Keys of 12, 13, 19 and more characters, other scripts, and none: routed reads find what was written."""
    keys = ["Customer#001", "Customer#0001", "Customer#000000001", "1234567890123456789", "", "é", "中文\U0001f602", "x" * 300, None] if kind == "string" else [123456789012, 1234567890123, 1234567890123456789, -(2**63), 5, None]
    table, path = Table("t", [even("k", "t")]), f"file://{tmp_path}/t"
    R.write_sharded(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, i int"), table, path)
    for i, k in enumerate(keys):
        if k is not None:
            found = R.read_sharded(spark, path, R.shards_of(table, *R.choose_route(table, {"k": [k]}))).where(F.col("k") == F.lit(k))
            assert [r.i for r in found.collect()] == [i]
    assert R.read_sharded(spark, path).count() == len(keys)


def test_two_dim_ids_route(spark, tmp_path):
    table = Table("t", [even("a", "t_a"), even("b", "t_b")], ["id"], "two_dim")
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"), H.encode_two_dim(F.col("id"), H.slot_of_integer(F.col("id")), H.slot_of_integer(F.col("id") * 7)).alias("id"))
    for dim in (0, 1):
        path = f"file://{tmp_path}/{dim}"
        R.write_sharded(df, table, path, dim)
        for r in df.where("a % 50 = 3").collect():
            kind, values = R.choose_route(table, {"id": [r.id]})
            shards = R.shards_of(table, kind, values, dim)
            assert kind == "composed" and len(shards) == 1 and R.read_sharded(spark, path, shards).where(F.col("id") == r.id).count() == 1
    with pytest.raises(ShardError):
        R.shards_of(table, "composed", ["zzz"])


def test_two_dim(spark):
    row = spark.range(1).select(H.encode_two_dim(F.lit("26383326abc"), H.slot(F.lit("123")), H.slot(F.lit("456"))).alias("i")).first()
    assert row.i == "26383326abc8c9d5"
    bad = spark.range(1).select(H.decode_two_dim(F.lit("zzzzz"), 0).alias("x"), H.decode_composed(F.lit("x")).alias("y")).first()
    assert bad == (-1, -1)


def test_composed(spark):
    row = spark.range(1).select(H.encode_composed(F.lit(100), H.slot(F.lit("123"))).alias("i"), H.decode_composed(F.lit("10000")).alias("s")).first()
    assert row == (102962, 784)


def test_expansion():
    assert expand_tables("t_[0-2,5,9-13-2]x") == ["t_0x", "t_1x", "t_2x", "t_5x", "t_9x", "t_11x", "t_13x"]
    assert expand_slots("0-1,2-4,8") == [0, 1, 2, 3, 4, 8]
    assert sorted(["b1c10", "a10", "a2", "b1c2"], key=natural) == ["a2", "a10", "b1c2", "b1c10"]


def test_catalog_refuses_gaps():
    with pytest.raises(ShardError):
        Dimension.of("k", {"t_0": "0-511"}, {"t_0": "db"})
    with pytest.raises(ShardError):
        Dimension.of("k", {"t_0": "0-1023"}, {})
    assert even("k", "t").prefix == "t_"


@pytest.mark.parametrize(
    "equal, index, expected",
    [({}, 2, "index"), ({"order_id": [1]}, None, "composed"), ({"o_custkey": [1], "o_orderkey": [1]}, None, "key"), ({"o_orderkey": [1]}, None, "mapping"), ({"o_orderkey": list(range(8))}, None, "all"), ({}, None, "all")],
)
def test_routes(equal, index, expected):
    assert R.choose_route(CATALOG["orders"], equal, shard_index=index)[0] == expected


def test_writes_need_one_shard():
    with pytest.raises(ShardError) as e:
        R.single_shard(CATALOG["orders"], "key", [1, 1000, 99999])
    assert e.value.code == "ERR_SQL_SYNTAX_ERROR"
    with pytest.raises(ShardError):
        R.choose_route(CATALOG["orders"], {}, strict=True)
    with pytest.raises(ShardError):
        dml.delete(None, "", [0], None)


def test_partitions_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    R.write_sharded(table(spark, SF, "orders"), CATALOG["orders"], path)
    df = R.read_sharded(spark, path, [3])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1][:80]
    assert {r.shard for r in df.select("shard").distinct().collect()} == {3}


def test_merge_of_empty_shards(spark):
    df = spark.createDataFrame([], "shard int, x int")
    row = merge.scatter_gather(df, {"n": ("count", F.col("x")), "s": ("sum", F.col("x"))}).first()
    assert row == (0, None)
    with pytest.raises(ValueError):
        merge.scatter_gather(df, {"a": ("avg", F.col("x"))})


def test_blocks(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([10, 10, 100, 0, 101, 1])] + [(None, 1, 3)], "seq string, req_no long, n long")
    got = {(r.seq, r.req_no): (r.begin_id, r.end_id) for r in sequences.allocate(df, 100, 100).collect()}
    assert [got["s", i] for i in range(6)] == [(101, 110), (111, 120), (201, 300), (None, None), (None, None), (301, 301)] and got[None, 1] == (101, 103)


def test_ring(spark):
    df = telemetry.ring(spark.range(1, 9).withColumnRenamed("id", "t"), 5, "t", "t").orderBy("t")
    assert [r.ring_sum for r in df.collect()] == [1, 3, 6, 10, 15, 20, 25, 30]


def test_pairs(spark):
    row = spark.range(1).select(X.parse_pairs(F.lit("a=1&b= 2 &junk&a=3=4&=z")).alias("m")).first()
    assert row.m == {"a": "3=4", "b": "2", "": "z"}
    assert spark.range(1).select(X.parse_pairs(F.lit("")).alias("m")).first().m == {}


def test_two_dimensions_agree(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    two = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, v string")
    assert {(r.id, r.state) for r in dml.compare_dimensions(one, two, "id", "v").collect()} == {(2, "different"), (3, "missing_in_second"), (4, "missing_in_first")}


def test_stream_windows_equal_batch(spark):
    got = {(r.win, r.grp): (round(r.total, 4), r.n) for r in QUERIES["stream_samples"](spark, SF).collect()}
    e = table(spark, SF, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("win"), "event_type").agg(F.sum("value").alias("t"), F.count("*").alias("n"))
    want = {(r.win, r.event_type): (round(r.t, 4), r.n) for r in e.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) > 0.9 * len(want)


def test_uneven_slots(spark):
    d = Dimension.of("k", {"t_2": "0-99", "t_10": "100-1023"}, {"t_[2,10-10]": "db"})
    rows = spark.range(-1, 1024).select("id", d.shard_column(F.col("id").cast("int")).alias("s")).collect()
    assert all(r.s == (None if r.id < 0 else int(r.id >= 100)) for r in rows) and d.tables == ["t_2", "t_10"]


def test_fuse_stream(spark):
    """The stream's states against one loop over each group's ticks."""
    from shardloom.streaming.fuse import step

    hour = F.expr("unix_timestamp(cast(ts as timestamp)) div 3600")
    e = table(spark, SF, "events").groupBy((F.col("user_id") % 10).cast("string").alias("grp"), hour.alias("tick"))
    rows = e.agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("k"), F.count(F.when(F.col("event_type") != "error", 1)).alias("p")).collect()
    want = {}
    for grp in {r.grp for r in rows}:
        state = ([], [], -1)
        for r in sorted((r for r in rows if r.grp == grp), key=lambda r: r.tick):
            *state, want[grp, r.tick] = step(*state, r.tick, r.k, r.p, 5, 3, 10)
    got = {(r.grp, r.tick): r.open for r in QUERIES["stream_fuse"](spark, SF).collect()}
    assert got == want and any(got.values()) and not all(got.values())


def test_shards_can_be_emptied(spark, tmp_path):
    t, path = Table("t", [even("k", "t", shards=2, databases=1)]), f"file://{tmp_path}/t"
    df = spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    R.write_sharded(df, t, path)
    held = {r.k: r.shard for r in R.read_sharded(spark, path).collect()}
    some = [k for k, s in held.items() if s == 0]
    dml.delete_rows(spark, path, [0], F.col("k").isin(some[:2]))
    assert {r.k for r in R.read_sharded(spark, path).collect()} == set(held) - set(some[:2])
    dml.delete_rows(spark, path, [0], F.col("v") == "x")
    assert {r.k for r in R.read_sharded(spark, path).collect()} == {k for k, s in held.items() if s == 1}
    dml.insert(df.where(F.col("k").isin(some)), t, path)
    dml.update_rows(spark, path, [0, 1], F.col("k") == 3, {"v": F.lit("y")})
    assert {r.k: r.v for r in R.read_sharded(spark, path).collect()} == {k: "y" if k == 3 else "x" for k in held}
    dml.delete_keys(spark, path, t, spark.createDataFrame([(3,), (4,), (99,), (None,)], "k long"))
    assert {r.k for r in R.read_sharded(spark, path).collect()} == set(held) - {3, 4}
    assert dml.truncate(spark, path, t) == [0, 1] and R.read_sharded(spark, path).count() == 0 and R.read_sharded(spark, path).columns == ["k", "v", "shard"]
    with pytest.raises(ShardError):
        dml.truncate(spark, path, t, [7])
    with pytest.raises(ShardError):
        dml.replace_shards(df.withColumn("shard", F.lit(1)), path, [0])
    assert dml.watched_columns(CATALOG["orders"], ["o_custkey", "o_comment"]) == ["o_custkey"]


def test_catalogs_are_loaded(spark, tmp_path):
    from shardloom.operators.catalog import catalog_of, config_of, load_catalog

    assert catalog_of(config_of(CATALOG)) == CATALOG
    one = {"tables": [{"name": "t", "dimensions": [{"columns": ["a", "b"], "slots": {"t_0": "0-511", "t_1": "512-1023"}, "databases": {"t_[0-1]": "db"}}], "composed": "x, y"}]}
    import json

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps(one, indent=1))
    got = load_catalog(spark, f"file://{tmp_path}/c")["t"]
    assert got.composed == ["x", "y"] and got.dimensions[0].columns == ["a", "b"] and got.dimensions[0].slots[600] == ("t_1", "db")
    (tmp_path / "c" / "b.json").write_text(json.dumps(one))
    with pytest.raises(ShardError):
        load_catalog(spark, f"file://{tmp_path}/c")


def test_rows_are_numbered_by_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"), (F.col("id") % 3).alias("g")).repartition(7)
    got = merge.number_rows(df, [F.col("g").desc(), F.col("x")]).collect()
    want = sorted(((r.g, r.x) for r in got), key=lambda t: (-t[0], t[1]))
    assert [(r.g, r.x) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 5001))
    assert merge.number_rows(df.limit(0), [F.col("x")]).count() == 0


def test_texts_merge_by_value(spark):
    df = spark.createDataFrame([("9", "10:00:00", "1.10"), ("10", "9:59:59", "2.9"), (None, "x", None)], "n string, t string, s string")
    row = merge.merge_partials(df, {"n": "max", "t": "min", "s": "sum"}, {"t": "time"}).first()
    assert row == ("10", "9:59:59", "4")
    assert merge.merge_partials(df.limit(0), {"n": "max", "s": "sum"}).first() == (None, None)


@pytest.mark.parametrize(
    "sql, pattern",
    [
        ("select a from t where b in(1,2)", "SELECT a FROM t WHERE b IN (?)"), ("insert into t values(1,'a'),(2,'b;')", "INSERT INTO t VALUES (?)"), ("SELECT a1, b_2 FROM t3 WHERE x=-1.5e3", "SELECT a1, b_2 FROM t3 WHERE x=?"),
        ("select '' , 'it''s' , 'a\\'b' from t ; ", "SELECT ? , ? , ? FROM t"), ("select 1 -- no\nfrom t", "SELECT ? FROM t"), ("select selected, format from orders_set", "SELECT selected, format FROM orders_set"), ("", ""),
    ],
)
def test_fingerprints(spark, sql, pattern):
    assert spark.range(1).select(X.fingerprint(F.lit(sql)).alias("p")).first().p == pattern


def test_quoted_names_stay(spark):
    row = spark.range(1).select(X.fingerprint(F.lit('select "col" from t'), True).alias("a"), X.fingerprint(F.lit('select "col" from t')).alias("b")).first()
    assert row == ('SELECT "col" FROM t', "SELECT ? FROM t")


def test_natural_keys_of_long_numbers(spark):
    names = ["a" + "9" * 24 + "1", "a" + "9" * 24 + "2", "a" + "1" + "0" * 25, "a7", "a07", "a10"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), F.length("n"), "n").collect()]
    assert got == sorted(names, key=natural)[:0] + ["a7", "a07", "a10", names[0], names[1], names[2]]


def test_allocator_survives_and_refuses_races(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    sequences.start_allocator(spark.createDataFrame([("s", 0, 10, 1, 35)], sequences.ALLOCATOR), path)
    assert [sequences.refill(spark, path, "s") for _ in range(4)] == [10, 20, 30, 1] and sequences.allocator(spark, path)[0] == 4
    with pytest.raises(ValueError):
        sequences.refill(spark, path, "none")


def test_sampling_keeps_first_sights_and_slow_ones(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 7).alias("p"), (F.col("id") % 1500).alias("millis"), F.col("id").alias("t"))
    got = {r.id for r in telemetry.audit_sample(df, "p", "id", X.sampling_rate(F.col("millis")), "t").collect()}
    assert set(range(7)) <= got and {i for i in range(3000) if i % 1500 >= 1000} <= got and 1000 + 80 < len(got) < 1000 + 320
