"""Functions over statements and configuration texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a statement's pattern that are kept.
MAX_PATTERN = 2 * 4096
# Weights and patterns of risky statements; a statement is risky from 8 on.
RISKY = [
    (4, r"^(?<res>.*)information_schema|system_user|@@version|@@version_compile_os|@@basedir|session_user|current_user|current_db|version_compile_os|mysql\."),
    (8, r"^(?<res>.*)sleep|benchmark|receive_message|pg_sleep"),
    (8, r"""^(?<res>.*)\-\-\s*['"]{1}[^'"]*$"""),
    (4, r"^(?<res>.*)/\*|/\*?!\d+|\-\-"),
    (8, r"""^(?<res>.*)['"]*\d+['|"]*\s*(=|>|<|>=|<=)\s*['|"]*\d+['|"]*"""),
    (8, r"^(?<res>.*)(and|or)+\s+\d+\s*[^=]+"),
    (4, r"^(?<res>.*)\b(elt|chr|substring|ascii|truncate|load_file|updatexml|extractvalue|xmltype|is_srvrolemember|char|strcmp|substr|bin|ord|hex|database)+\("),
    (4, r"^(?<res>.*)\||\^|~|xor"),
    (8, r"^(?<res>.*)select\s*\d+\s*,\s*\d+\s*"),
    (4, r"""^(?<res>.*)(\b|'|")0x"""),
]
RISK_LIMIT, RISK_LENGTHS = 8, (15, 65536)


def parse_pairs(text: Column) -> Column:
    """'a=1&b=2' as a map: split once at '=', trimmed, entries without '=' dropped, the last of equal keys wins."""
    parts = F.filter(F.split(text, "&"), lambda x: F.instr(x, "=") > 0)
    key = lambda x: F.trim(F.substring_index(x, "=", 1))
    value = lambda x: F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x)))
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts), F.lit(1))), lambda y: key(y) == key(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(key(x), value(x))))


_META = r"(?s)^(/\*\s*E:(.*?):E\s*\*/)(.*)$"


def meta_comment(sql: Column) -> Column:
    """(comment, content, body) of a statement with a leading /* E:...:E */ comment; else no comment and the whole."""
    has = sql.rlike(_META)
    part = lambda i: F.when(has, F.regexp_extract(sql, _META, i)).otherwise("")
    return F.struct(part(1).alias("comment"), part(2).alias("content"), F.when(has, F.regexp_extract(sql, _META, 3)).otherwise(sql).alias("body"))


_TEXTS = r"'(?:[^'\\]|\\.|'')*'"
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'
_NUMBER = r"(?<![\w.?])[+-]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w)"
_TUPLE = r"\((?:[^()]|\([^()]*\))*\)"
KEYWORDS = (
    "select from where and or insert into update set delete order group by limit offset having join left right inner outer cross on using as like between is not null "
    "distinct desc asc in values union all exists case when then else end replace truncate table"
).split()


def without_literals(sql: Column, quoted_names: bool = False) -> Column:
    """A statement with ? for its literals and value lists, and one space for blanks and comments.

    ``quoted_names``: double quotes hold names, as in standard SQL, not texts.
    """
    literal = "|".join([_TEXTS, *([] if quoted_names else [_QUOTED]), _NUMBER])
    steps = [
        (r"(?s)/\*.*?\*/|--[ \t][^\n]*", " "),
        (literal, "?"),
        (r"\s+", " "),
        (r"(?i)\bIN ?\( ?\?(?: ?, ?\?)* ?\)", "IN (?)"),
        (rf"(?i)\bVALUES ?{_TUPLE}(?: ?, ?{_TUPLE})*", "VALUES (?)"),
        (r"^ | ?;? ?$", ""),
    ]
    for pattern, to in steps:
        sql = F.regexp_replace(sql, pattern, to)
    return sql


def upper_keywords(sql: Column) -> Column:
    """A statement without literals with its keywords in upper case; one pass cuts it at the edges of words."""
    words = F.transform(F.split(sql, r"\b"), lambda w: F.when(F.lower(w).isin(*KEYWORDS), F.upper(w)).otherwise(w))
    return F.substring(F.array_join(words, ""), 1, MAX_PATTERN)


def fingerprint(sql: Column, quoted_names: bool = False) -> Column:
    """A statement's pattern: literals become ?, value lists one ?, blanks one space, keywords upper case; cut at MAX_PATTERN."""
    return upper_keywords(without_literals(sql, quoted_names))


def pattern_counts(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """pattern, n: how often each pattern occurs; keywords are looked for once in each distinct form."""
    forms = statements.groupBy(without_literals(F.col(sql)).alias("form")).agg(F.count("*").alias("n"))
    return forms.groupBy(upper_keywords(F.col("form")).alias("pattern")).agg(F.sum("n").alias("n"))


PARSE_FAIL = "[dal_parse_fail] "


def pattern_or_start(sql: Column) -> Column:
    """A statement's pattern; for one that isn't a statement PARSE_FAIL and its first 32 characters."""
    plain = F.upper(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "))
    bad = plain.rlike(r"\b(SELECT|FROM|WHERE|SET|INTO|BY)\s+(FROM|WHERE|GROUP|ORDER|HAVING|LIMIT)\b") | plain.rlike(r"\b(WHERE|AND|OR|SELECT|FROM)\s*;?\s*$") | (classify(sql) == "OTHER")
    return F.when(bad, F.concat(F.lit(PARSE_FAIL), F.substring(sql, 1, 32))).otherwise(fingerprint(sql))


def sql_id(pattern: Column) -> Column:
    return F.md5(pattern)


def joined_pattern(patterns: Column) -> Column:
    """Several statements' patterns as one: the distinct ones, and _x_N where they repeat."""
    distinct = F.array_distinct(patterns)
    repeats = F.concat(F.lit("_x_"), F.size(patterns).cast("string"))
    return F.concat(F.array_join(distinct, "; "), F.when(F.size(distinct) < F.size(patterns), repeats).otherwise(""))


def classify(sql: Column) -> Column:
    """The kind of a statement by its first words."""
    s = F.upper(F.regexp_replace(F.trim(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")), r"\s+", " "))
    kinds = [
        (r"^SELECT .* FOR UPDATE", "SELECT_FOR_UPDATE"), (r"^(SELECT|\(SELECT|WITH)\b", "SELECT"), (r"^INSERT\b", "INSERT"), (r"^REPLACE\b", "REPLACE"), (r"^UPDATE\b", "UPDATE"),
        (r"^DELETE\b", "DELETE"), (r"^TRUNCATE\b", "TRUNCATE"), (r"^(BEGIN|START TRANSACTION)", "BEGIN"), (r"^COMMIT\b", "COMMIT"), (r"^ROLLBACK TO\b", "ROLLBACK_TO"), (r"^ROLLBACK\b", "ROLLBACK"),
        (r"^SAVEPOINT\b", "SAVEPOINT"), (r"^RELEASE\b", "RELEASE"), (r"^SET AUTOCOMMIT", "SET_AUTOCOMMIT"), (r"^SET\b", "SET"), (r"^SHOW\b", "SHOW"), (r"^(DESC|DESCRIBE|EXPLAIN)\b", "EXPLAIN"),
        (r"^(CREATE|ALTER|DROP)\b", "DDL"), (r"^KILL\b", "KILL"), (r"^USE\b", "USE"), (r"^CALL\b", "CALL"),
    ]
    out = None
    for pattern, kind in kinds:
        out = F.when(s.rlike(pattern), kind) if out is None else out.when(s.rlike(pattern), kind)
    return out.otherwise("OTHER")


def writes(kind: Column) -> Column:
    return kind.isin("INSERT", "REPLACE", "UPDATE", "DELETE", "TRUNCATE", "SELECT_FOR_UPDATE", "DDL")


def white_fields(sql: Column, names: list[str]) -> Column:
    """The values of listed columns in a statement's conditions: 'col = value#...'."""
    found = F.regexp_extract_all(sql, F.lit(rf"(?i)\b((?:{'|'.join(names)})\s*=\s*(?:'[^']*'|\d+))"), 1)
    return F.array_join(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*=\s*", " = "), "'", "")), "#")


def danger(sql: Column) -> Column:
    """The sum of the weights of risky patterns; 0 for statements that are too short or too long to be judged."""
    hits = [F.when(sql.rlike(f"(?s){p}"), w).otherwise(0) for w, p in RISKY]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.when(F.length(sql).between(*RISK_LENGTHS), total).otherwise(0)


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value, however long they are; sort by the text itself after it.

    A run is written without leading zeros behind its length, which itself stands behind its own number of digits.
    """
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        n = F.length(digits).cast("string")
        return F.when(x.rlike(r"^[0-9]"), F.concat(F.lit("0"), F.length(n).cast("string"), n, digits)).otherwise(x)

    return F.array_join(F.transform(parts, key), "")


def with_meta(sql: Column, **pairs: Column) -> Column:
    """A statement behind a comment /*E:a=1&b=2:E*/ with some values."""
    text = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), v) for k, v in pairs.items()))
    return F.concat(F.lit("/*E:"), text, F.lit(":E*/"), sql)


def blank_free(sql: Column) -> Column:
    return F.regexp_replace(sql, r"\s+", "")


def rejected_by_pattern(statements: DataFrame, patterns: list[str], ids: DataFrame, sql: str = "sql") -> DataFrame:
    """Statements that hold one of some texts, blanks aside, or whose MD5 is in a table of rules (id)."""
    rules = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    held = F.lit(False)
    for p in patterns:
        held = held | blank_free(F.col(sql)).contains(p.replace(" ", ""))
    marked = statements.withColumn("id", F.md5(F.col(sql))).join(rules, "id", "left")
    return marked.where(held | F.coalesce("_listed", F.lit(False))).drop("id", "_listed")


def rejected_by_regex(sql: Column, patterns: list[str], blanks: bool = False) -> Column:
    """Whether one of some regular expressions is found in a statement, without its blanks unless ``blanks``."""
    text, out = sql if blanks else blank_free(sql), F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


SCAN_LENGTH = 512_000


def scans_all_shards(sql: Column, keys: list[str]) -> Column:
    """Whether a statement asks for no value of a key, or is too long to tell."""
    asked = F.lit(False)
    for k in keys:
        asked = asked | sql.rlike(rf"(?i)\b{k}\s*(=|in\b)")
    return ~asked | (F.length(sql) > SCAN_LENGTH)


def named_table(sql: Column) -> Column:
    """(db, tab) that a statement's first FROM, INTO, UPDATE or JOIN names; db is empty where none is given."""
    pattern = r"(?i)\b(?:from|into|update|join)\s+(?:`?(\w+)`?\s*\.\s*)?`?(\w+)`?"
    return F.struct(F.regexp_extract(sql, pattern, 1).alias("db"), F.regexp_extract(sql, pattern, 2).alias("tab"))


def with_index_hint(sql: Column, pattern_id: Column, index: str) -> Column:
    """A statement with USE INDEX behind its table if its pattern has the id of a rule."""
    hinted = F.regexp_replace(sql, r"(?i)\bFROM (\w+)", f"FROM $1 USE INDEX ({index})")
    return F.when(sql_id(fingerprint(sql)) == pattern_id, hinted).otherwise(sql)


def statements_of(sql: Column) -> Column:
    """The statements of a text that holds several, parted by ; outside of texts."""
    marked = F.regexp_replace(sql, rf"({_TEXTS}|{_QUOTED})|;", "$1\u0001")
    whole = F.regexp_replace(marked, "(['\"])\u0001", "$1")
    return F.filter(F.transform(F.split(whole, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def multi_statements(texts: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """key, parts, multi_trans: how many statements each text holds and whether one of several writes."""
    held = texts.select(key, F.size(statements_of(F.col(sql))).alias("parts"), F.explode_outer(statements_of(F.col(sql))).alias("one"))
    return held.groupBy(key, "parts").agg(F.coalesce(F.bool_or(F.coalesce(writes(classify(F.col("one"))), F.lit(False))), F.lit(False)).alias("w")).select(key, "parts", ((F.col("parts") > 1) & F.col("w")).alias("multi_trans"))


def transaction_id(number: Column, in_transaction: Column, autocommit: Column) -> Column:
    """The id of a unit of work: t for a transaction, a for a single write, q for a query."""
    return F.concat(F.when(in_transaction, "t").when(autocommit, "a").otherwise("q"), number.cast("string"))


def sampling_rate(millis: Column) -> Column:
    """One of how many events is sampled, by latency: slow ones all."""
    return F.when(millis < 10, 1000).when(millis < 100, 100).when(millis < 1000, 10).otherwise(1)


def safe_div(a: Column, b: Column) -> Column:
    return a / (b + 0.001)


def smart_kill_millis(queue: Column, upper: int, slow_millis: int) -> Column:
    """From how slow on statements are killed: ``slow_millis`` from a queue of ``upper`` on, twice that from half of it, and so on; never for an empty queue."""
    halvings = F.filter(F.sequence(F.lit(0), F.lit(max(0, upper.bit_length() - 1))), lambda k: queue >= F.floor(F.lit(upper) / F.pow(F.lit(2), k)))
    return F.coalesce((F.lit(slow_millis) * F.pow(F.lit(2), F.array_min(halvings))).cast("long"), F.lit(2**31 - 1).cast("long"))


def features(sql: Column, key: str) -> Column:
    """What a statement asks for: kind, tab, table (db.tab as written), one_key (one value of the key), many_keys (several
    by IN), ored, group_by, order_by, distinct, lim and off_set (null without), aggregates (its functions, in order)."""
    one = sql.rlike(rf"(?i)\b{key}\s*=\s*('[^']*'|\d+)") & ~sql.rlike(r"(?i)\bor\b")
    named = named_table(sql)
    number = lambda p: F.coalesce(*(F.regexp_extract(sql, x, 1).try_cast("bigint") for x in p))
    return F.struct(
        classify(sql).alias("kind"),
        named["tab"].alias("tab"),
        F.when(named["db"] == "", named["tab"]).otherwise(F.concat_ws(".", named["db"], named["tab"])).alias("table"),
        one.alias("one_key"),
        sql.rlike(rf"(?i)\b{key}\s+in\s*\(").alias("many_keys"),
        sql.rlike(r"(?i)\bor\b").alias("ored"),
        sql.rlike(r"(?i)\bgroup\s+by\b").alias("group_by"),
        sql.rlike(r"(?i)\border\s+by\b").alias("order_by"),
        sql.rlike(r"(?i)\bselect\s+distinct\b").alias("distinct"),
        number([r"(?i)\blimit\s+\d+\s*,\s*(\d+)", r"(?i)\blimit\s+(\d+)"]).alias("lim"),
        number([r"(?i)\boffset\s+(\d+)", r"(?i)\blimit\s+(\d+)\s*,"]).alias("off_set"),
        F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\b(count|sum|min|max|avg)\s*\("), 1), F.upper), ",").alias("aggregates"),
    )
