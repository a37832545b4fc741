"""Queries over statement texts and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import hashing as H
from shardloom.functions import text as X
from shardloom.operators.dml import spanning_transactions
from shardloom.plans.registry import query, slot_sql
from shardloom.sources.tables import table

_SQL = "'SELECT * FROM orders WHERE o_custkey = ' || o_custkey || ' AND o_orderstatus = ''' || o_orderstatus || ''''"


def _statements(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("SELECT * FROM orders WHERE o_custkey = "), F.col("o_custkey"), F.lit(" AND o_orderstatus = '"), "o_orderstatus", F.lit("'"))
    return o.select("o_orderkey", "o_custkey", text.alias("sql"))


def _given(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("fn_slot", f"SELECT event_id, {slot_sql('event_type')} AS slot FROM events")
def fn_slot(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", H.slot(F.col("event_type")).alias("slot"))


@query("fn_slot_unicode", "SELECT 'beyond' AS what, 191 AS slot")
def fn_slot_unicode(spark, sf_dir):
    return _given(spark, [("beyond", "\U0001f602''\u4e2d\u6587")], "what string, k string").select("what", H.slot(F.col("k")).alias("slot"))


@query("fn_is_numeric_id", "SELECT * FROM (VALUES ('12', true), ('-7', true), ('+7', true), (' 12', false), ('1e3', false), ('', false), ('99999999999999999999', false), (NULL, false)) t(v, ok)")
def fn_is_numeric_id(spark, sf_dir):
    rows = [(v,) for v in ("12", "-7", "+7", " 12", "1e3", "", "99999999999999999999", None)]
    return _given(spark, rows, "v string").select("v", H.is_numeric_id(F.col("v")).alias("ok"))


@query("fn_kv_parse", "SELECT event_id, user_id::VARCHAR AS u, event_type AS t, 2 AS n FROM events")
def fn_kv_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("junk&u=0& u = "), F.col("user_id"), F.lit("&t="), F.col("event_type"))
    m = X.parse_pairs(text)
    return e.select("event_id", m["u"].alias("u"), m["t"].alias("t"), F.size(m).alias("n"))


@query("fn_meta_comment", "SELECT * FROM (VALUES (1, '/* E:a=1:E */', 'a=1', ' SELECT 1'), (2, '', '', 'SELECT /* E:x:E */ 1'), (3, '/*E:a:b=2:E*/', 'a:b=2', 'SELECT 2')) t(i, comment, content, body)")
def fn_meta_comment(spark, sf_dir):
    rows = [(1, "/* E:a=1:E */ SELECT 1"), (2, "SELECT /* E:x:E */ 1"), (3, "/*E:a:b=2:E*/SELECT 2")]
    return _given(spark, rows, "i int, s string").select("i", X.meta_comment(F.col("s")).alias("m")).select("i", "m.*")


@query("fn_trunc_sql", "SELECT p_partkey, least(8192, length(p_name) * 1000) AS n FROM part")
def fn_trunc_sql(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.length(F.substring(F.repeat("p_name", 1000), 1, X.MAX_PATTERN)).cast("long").alias("n"))


@query("fn_safe_div", "SELECT event_id, round(value / (user_id + 0.001), 9) AS x FROM events")
def fn_safe_div(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(X.safe_div(F.col("value"), F.col("user_id")), 9).alias("x"))


@query("fn_grade_sample", "SELECT event_id, CASE WHEN value < 10 THEN 1000 WHEN value < 100 THEN 100 WHEN value < 1000 THEN 10 ELSE 1 END AS rate FROM events")
def fn_grade_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.sampling_rate(F.col("value")).alias("rate"))


@query("txt_fingerprint", "SELECT 'SELECT * FROM orders WHERE o_custkey = ? AND o_orderstatus = ?' AS pattern, count(*) AS n FROM orders")
def txt_fingerprint(spark, sf_dir):
    return X.pattern_counts(_statements(spark, sf_dir))


@query("txt_fingerprint_shapes", "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'SELECT a FROM t WHERE k IN (?) AND b = ?' WHEN 1 THEN 'INSERT INTO t (a, b) VALUES (?)' WHEN 2 THEN 'UPDATE t SET a = ? WHERE k = ?' ELSE 'DELETE FROM t WHERE k = ? LIMIT ?' END AS pattern, count(*) AS n FROM orders GROUP BY 1")
def txt_fingerprint_shapes(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    shapes = [("select  a from t where k in(", ", 5,6) and b = 'it''s'"), ("insert into t (a, b) values(", ",'x'),( 2 , 'y;')"), ("update t set a = -1.5e3 /* no */ where k=", ";"), ("delete from t where k = ", "\nlimit 10 -- done")]
    text = F.lit(None).cast("string")
    for i, (a, b) in enumerate(shapes):
        text = F.when(F.col("o_orderkey") % 4 == i, F.concat(F.lit(a), k, F.lit(b))).otherwise(text)
    spaced = F.regexp_replace(text, "k=", "k = ")
    return X.pattern_counts(table(spark, sf_dir, "orders").select(spaced.alias("sql")))


@query("txt_fingerprint_golden", "SELECT * FROM (VALUES (1, 'INSERT INTO t (a, b) VALUES (?)'), (2, 'SELECT a FROM t WHERE b IN (?) AND c > ?'), (3, 'DELETE FROM t WHERE n = ?')) t(i, pattern)")
def txt_fingerprint_golden(spark, sf_dir):
    rows = [(1, "insert into t (a, b) values (1, 'x'), (2, 'y')"), (2, "select a  from t where b in (1,2 , 3) and c > 4.5"), (3, "delete from t where n = 'it''s';")]
    return _given(spark, rows, "i int, s string").select("i", X.fingerprint(F.col("s")).alias("pattern"))


@query("txt_sql_id", "SELECT '4c15c759d8707a99b700666e51d0c3ef' AS id")
def txt_sql_id(spark, sf_dir):
    return spark.range(1).select(X.sql_id(F.lit("SELECT id FROM tb_active_target WHERE target_type = ? AND target_id = ?")).alias("id"))


@query("txt_fp_multi", "SELECT * FROM (VALUES (1, 'A; B'), (2, 'A_x_3')) t(i, pattern)")
def txt_fp_multi(spark, sf_dir):
    return _given(spark, [(1, ["A", "B"]), (2, ["A", "A", "A"])], "i int, p array<string>").select("i", X.joined_pattern(F.col("p")).alias("pattern"))


@query("txt_white_fields", "SELECT o_orderkey, 'o_custkey = ' || o_custkey AS fields FROM orders")
def txt_white_fields(spark, sf_dir):
    return _statements(spark, sf_dir).select("o_orderkey", X.white_fields(F.col("sql"), ["o_custkey"]).alias("fields"))


@query("txt_meta", f"SELECT o_orderkey, '/*E:group=g&sqlid=' || md5('x') || ':E*/' || {_SQL} AS sql FROM orders")
def txt_meta(spark, sf_dir):
    return _statements(spark, sf_dir).select("o_orderkey", X.with_meta(F.col("sql"), group=F.lit("g"), sqlid=F.md5(F.lit("x"))).alias("sql"))


@query("txt_reject_pattern", f"SELECT o_orderkey FROM orders WHERE contains(replace({_SQL}, ' ', ''), 'o_custkey=77') OR md5({_SQL}) = md5('SELECT * FROM orders WHERE o_custkey = 5 AND o_orderstatus = ''F''')")
def txt_reject_pattern(spark, sf_dir):
    s = _statements(spark, sf_dir)
    ids = spark.createDataFrame([("SELECT * FROM orders WHERE o_custkey = 5 AND o_orderstatus = 'F'",)], "p string").select(F.md5("p").alias("id"))
    return X.rejected_by_pattern(s, ["o_custkey = 77"], ids).select("o_orderkey")


@query("txt_reject_regex", f"SELECT o_orderkey FROM orders WHERE regexp_matches(replace({_SQL}, ' ', ''), '(?i)O_CUSTKEY=1[0-9]AND')")
def txt_reject_regex(spark, sf_dir):
    return _statements(spark, sf_dir).where(X.rejected_by_regex(F.col("sql"), [r"(?i)O_CUSTKEY=1[0-9]AND"])).select("o_orderkey")


_SHADY = [
    "SELECT a FROM t WHERE b = 'x'", "SELECT a FROM t WHERE b = 'x' or 1=1", "select sleep(5) from t where b = 'x'", "or 1=1", "select 1,2,3 from t union all", "SELECT hex(a) FROM t WHERE b = 0x41",
    "select a from information_schema.t where b = 'x'", "select a from t -- ' and more", "select a from t /* note */ where b ^ c", "select a from t where b and 7 > c",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WEIGHT = " + ".join(f"CASE WHEN regexp_matches(s, {_quoted(p.replace('(?<', '(?P<'))}, 's') THEN {w} ELSE 0 END" for w, p in X.RISKY)


@query("txt_danger_score", f"SELECT i, w AS weight, w >= 8 AS risky FROM (SELECT i, CASE WHEN length(s) BETWEEN 15 AND 65536 THEN {_WEIGHT} ELSE 0 END AS w FROM (VALUES " + ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(_SHADY)) + ") t(i, s))")
def txt_danger_score(spark, sf_dir):
    df = _given(spark, list(enumerate(_SHADY)), "i int, s string").select("i", X.danger(F.col("s")).alias("weight"))
    return df.withColumn("risky", F.col("weight") >= X.RISK_LIMIT)


@query("fn_smart_kill", "SELECT q.range AS queue, coalesce((SELECT 500 * (2 ** min(k.range))::BIGINT FROM range(6) k WHERE q.range >= (40 >> k.range)), 2147483647) AS millis FROM range(60) q")
def fn_smart_kill(spark, sf_dir):
    return spark.range(60).select(F.col("id").alias("queue"), X.smart_kill_millis(F.col("id"), 40, 500).alias("millis"))


@query("txt_scan_all_risk", "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0")
def txt_scan_all_risk(spark, sf_dir):
    s = _statements(spark, sf_dir)
    text = F.when(F.col("o_orderkey") % 100 == 0, F.lit("SELECT * FROM orders WHERE o_orderstatus = 'F'")).otherwise(F.col("sql"))
    return s.withColumn("sql", text).where(X.scans_all_shards(F.col("sql"), ["o_custkey"])).select("o_orderkey")


@query("txt_specify_db", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'db' || o_custkey % 3 ELSE '' END AS db, 'orders' AS tab FROM orders")
def txt_specify_db(spark, sf_dir):
    db = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("db"), F.col("o_custkey") % 3, F.lit("."))).otherwise("")
    s = _statements(spark, sf_dir).withColumn("sql", F.regexp_replace(F.col("sql"), F.lit("FROM "), F.concat(F.lit("from "), db)))
    return s.select("o_orderkey", X.named_table(F.col("sql")).alias("t")).select("o_orderkey", "t.*")


_KINDS = [
    ("select 1", "SELECT"), ("SELECT a FROM t FOR UPDATE", "SELECT_FOR_UPDATE"), ("/* x */ insert into t values (1)", "INSERT"), ("replace into t values (1)", "REPLACE"), ("update t set a=1", "UPDATE"),
    ("delete from t", "DELETE"), ("truncate table t", "TRUNCATE"), ("begin", "BEGIN"), ("start transaction", "BEGIN"), ("commit", "COMMIT"), ("rollback", "ROLLBACK"), ("rollback to s1", "ROLLBACK_TO"),
    ("savepoint s1", "SAVEPOINT"), ("set autocommit=1", "SET_AUTOCOMMIT"), ("show tables", "SHOW"), ("create table t (a int)", "DDL"), ("kill 5", "KILL"), ("hello", "OTHER"),
]


@query("stmt_classify", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {'true' if k in ('INSERT', 'REPLACE', 'UPDATE', 'DELETE', 'TRUNCATE', 'SELECT_FOR_UPDATE', 'DDL') else 'false'})" for i, (_, k) in enumerate(_KINDS)) + ") t(i, kind, writes)")
def stmt_classify(spark, sf_dir):
    df = _given(spark, [(i, s) for i, (s, _) in enumerate(_KINDS)], "i int, s string")
    return df.select("i", X.classify(F.col("s")).alias("kind")).withColumn("writes", X.writes(F.col("kind")))


@query("stmt_multi", "SELECT * FROM (VALUES (1, 2, true), (2, 2, false), (3, 1, false), (4, 2, true), (5, 0, false)) t(i, parts, multi_trans)")
def stmt_multi(spark, sf_dir):
    texts = [(1, "select 1; update t set a = 1"), (2, "select 1; select 2;"), (3, "update t set a = ';' where b = \"x;y\""), (4, "insert into t values ('a;b'); select 1 ;"), (5, " ; ")]
    return X.multi_statements(_given(spark, texts, "i int, sql string"), "i")


@query("tx_single_shard", f"SELECT o_orderkey // 3 AS tx, count(DISTINCT {slot_sql('o_custkey')}) AS slots FROM orders GROUP BY 1 HAVING count(DISTINCT {slot_sql('o_custkey')}) > 1")
def tx_single_shard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 3").alias("tx"), H.slot_of_integer(F.col("o_custkey")).alias("slot"))
    return spanning_transactions(o)


@query("tx_ids", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 't' WHEN 'error' THEN 'a' ELSE 'q' END || event_id AS id FROM events")
def tx_ids(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", X.transaction_id(F.col("event_id"), kind == "purchase", kind == "error").alias("id"))


_FEATURES = [
    ("select a, count(*) from lineitem where b > 2 group by a limit 5", ("SELECT", "lineitem", "lineitem", False, False, False, True, False, False, 5, None, "COUNT")),
    ("select distinct x from `db1`.`orders` where o_custkey in (1, 2) or y = 3 order by x limit 20, 10", ("SELECT", "orders", "db1.orders", False, True, True, False, True, True, 10, 20, "")),
    ("UPDATE t SET a = 1 WHERE o_custkey = 'k'", ("UPDATE", "t", "t", True, False, False, False, False, False, None, None, "")),
    ("select max(a), MIN(b), sum( c ) from t where o_custkey=7 limit 3 offset 9", ("SELECT", "t", "t", True, False, False, False, False, False, 3, 9, "MAX,MIN,SUM")),
]
_FIELDS = ("kind", "tab", "table", "one_key", "many_keys", "ored", "group_by", "order_by", "distinct", "lim", "off_set", "aggregates")


def _value(x) -> str:
    return "NULL::BIGINT" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


def _fields(values) -> str:
    return ", ".join(f'{_value(v)} AS "{n}"' for n, v in zip(_FIELDS, values, strict=True))


@query("txt_features", "SELECT o_orderkey, " + _fields(("SELECT", "orders", "orders", True, False, False, False, False, False, None, None, "")) + " FROM orders" + "".join(f" UNION ALL SELECT {-i}, {_fields(f)}" for i, (_, f) in enumerate(_FEATURES, 1)))
def txt_features(spark, sf_dir):
    s = _statements(spark, sf_dir).select("o_orderkey", "sql")
    s = s.union(_given(spark, [(-i, t) for i, (t, _) in enumerate(_FEATURES, 1)], "o_orderkey long, sql string"))
    return s.select("o_orderkey", X.features(F.col("sql"), "o_custkey").alias("f")).select("o_orderkey", "f.*")


@query("txt_reject_real_regex", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F'")
def txt_reject_real_regex(spark, sf_dir):
    return _statements(spark, sf_dir).where(X.rejected_by_regex(F.col("sql"), [r"o_custkey = \d*3 AND o_orderstatus = 'F'$"], blanks=True)).select("o_orderkey")


@query("txt_fp_fail", "SELECT 1 AS i, '[dal_parse_fail] select from where and so on and ' AS pattern UNION ALL SELECT 2, 'SELECT a FROM t WHERE b = ?' UNION ALL SELECT 3, '[dal_parse_fail] what is this' UNION ALL SELECT 4, '[dal_parse_fail] delete from t where'")
def txt_fp_fail(spark, sf_dir):
    df = _given(spark, [(1, "select from where and so on and it goes on and on"), (2, "select a from t where b = 7"), (3, "what is this"), (4, "delete from t where")], "i int, s string")
    return df.select("i", X.pattern_or_start(F.col("s")).alias("pattern"))


@query("txt_index_hint", "SELECT o_orderkey, replace(" + _SQL + ", 'FROM orders', 'FROM orders USE INDEX (ix_cust)') AS sql FROM orders")
def txt_index_hint(spark, sf_dir):
    rule = F.md5(F.lit("SELECT * FROM orders WHERE o_custkey = ? AND o_orderstatus = ?"))
    return _statements(spark, sf_dir).select("o_orderkey", X.with_index_hint(F.col("sql"), rule, "ix_cust").alias("sql"))
