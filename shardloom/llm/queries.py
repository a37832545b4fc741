"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch, tokenizer_file
from shardloom.llm.forest import near_duplicate_vectors, nearest_neighbours
from shardloom.llm.mixing import mix_sources
from shardloom.llm.near_dedup import near_duplicates
from shardloom.llm.packing import pack_documents
from shardloom.llm.quality import quality_scores
from shardloom.llm.sharding import assign_shards
from shardloom.llm.suffix_dedup import repeated_strings
from shardloom.llm.token_tables import lookup, write_tables
from shardloom.llm.warc import find_captures, read_records, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').root}/archive"
    pages = _table(spark, sf_dir, "pages")
    write_archive(pages, path, least_bytes=0)
    records = read_records(path, find_captures(path, pages))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_shards(_table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(_table(spark, sf_dir, "documents"), length=50)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-tables').root}/files"
    docs = _table(spark, sf_dir, "documents")
    write_tables(docs, path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return lookup(path, docs).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_neighbours": op2_neighbours,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_packing": op8_packing,
    "op9_token_tables": op9_token_tables,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))
                                      WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS h FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: printf('%04b', CAST('0x' || substr(sha, i + 1, 1) AS INTEGER))), '') AS bits FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER)), lambda x, y: 2 * x + y), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
""",
    "op4_sharding": """
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
         (CAST('0x' || substr(md5(concat_ws(':', '11', 'source', source)), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS o FROM documents),
c AS (
  SELECT *, CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS crc FROM d, t),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, crc) AS copy FROM c),
s AS (SELECT *, (CAST('0x' || substr(md5(concat_ws(':', '11', doc_id, size, crc, copy)), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u FROM n),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY u, doc_id) - o) / count(*) OVER (PARTITION BY source) AS frac FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, u, doc_id) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (place * 8 // n)::INTEGER AS shard,
       (place - ((place * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
""",
    "op6_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 100)) AS k FROM (SELECT doc_id, x, unnest(range(n - 49)) AS s FROM h)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
c AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM w JOIN f USING (k) WHERE doc_id > m),
g AS (SELECT doc_id, s, sum(CASE WHEN s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM c),
r AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY doc_id, run),
l AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM r),
k AS (
  SELECT h.doc_id, h.n, count(l.a) AS spans, coalesce(sum(l.b - l.a), 0) AS gone,
         substr(any_value(x), 1, 2 * coalesce(min(l.a), h.n)) || coalesce(string_agg(substr(x, 2 * l.b + 1, 2 * (coalesce(l.after, h.n) - l.b)), '' ORDER BY l.a), '') AS rest
  FROM h LEFT JOIN l ON l.doc_id = h.doc_id GROUP BY h.doc_id, h.n)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM k
""",
    "op7_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = e.vec_id
""",
    "op10_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS ss, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s0),
fill AS (
  SELECT 0 AS k, (SELECT sum(ss) FROM s1)::DOUBLE AS free, (SELECT sum(w) FROM s1) AS fw, -1.0::DOUBLE AS lim
  UNION ALL
  SELECT k + 1, (SELECT (SELECT sum(ss) FROM s1) - coalesce(sum(3 * ss) FILTER (WHERE free / fw * w > 3 * ss), 0) FROM s1)::DOUBLE,
         (SELECT sum(w) - coalesce(sum(w) FILTER (WHERE free / fw * w > 3 * ss), 0) FROM s1), free / fw
  FROM fill WHERE k < 200 AND fw > 0 AND lim < free / fw),
level AS (SELECT free / fw AS l FROM fill WHERE fw > 0 ORDER BY k DESC LIMIT 1),
s2 AS (SELECT *, least(l * w, 3.0 * ss) AS target FROM s1, level),
s3 AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss + 1e-12) ELSE 0 END AS whole FROM s2),
s4 AS (SELECT *, greatest(0, target - whole * ss) AS rest, ceil(n / 4096.0) AS b FROM s3),
s5 AS (SELECT *, CASE WHEN ss > 0 THEN least(1 - 1e-9, greatest(1e-9, rest / ss)) ELSE 1e-9 END AS chance FROM s4),
r AS (
  SELECT c.doc_id, c.source, c.size, c.copy, s.ss, s.target, s.whole, s.rest, s.b, s.chance,
         (CAST('0x' || substr(md5('17:' || c.doc_id || ':' || c.copy || ':' || c.size), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM copies c JOIN s5 s ON c.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, u / (1 - u) * (1 - chance) / chance AS q FROM r),
bk AS (SELECT *, floor(q / (1 + q) * b) AS bucket FROM q),
cm AS (SELECT source, bucket, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS reach, words FROM (SELECT source, bucket, sum(size) AS words FROM bk GROUP BY ALL)),
cut AS (SELECT c.source, min(bucket) AS cut, min(reach) - arg_min(words, bucket) AS before FROM cm c JOIN s5 s ON c.source IS NOT DISTINCT FROM s.source WHERE reach >= rest GROUP BY c.source),
o AS MATERIALIZED (
  SELECT bk.*, cut, before, row_number() OVER (PARTITION BY bk.source, bucket ORDER BY q, doc_id, copy) AS i
  FROM bk JOIN cut ON bk.source IS NOT DISTINCT FROM cut.source),
g AS (
  SELECT source, 0 AS i, (rest - before)::DOUBLE AS room, false AS took FROM (SELECT DISTINCT source, rest, before FROM o)
  UNION ALL
  SELECT g.source, o.i, CASE WHEN o.size > 0 AND o.size <= g.room THEN g.room - o.size ELSE g.room END, o.size > 0 AND o.size <= g.room
  FROM g JOIN o ON o.source IS NOT DISTINCT FROM g.source AND o.bucket = o.cut AND o.i = g.i + 1),
e AS (SELECT source, arg_max(room, i) AS room FROM g GROUP BY source),
x AS (
  SELECT o.source, o.i, row_number() OVER (PARTITION BY o.source ORDER BY abs(o.size - e.room), o.i) AS r
  FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source AND o.i = g.i JOIN e ON e.source IS NOT DISTINCT FROM o.source
  WHERE o.bucket = o.cut AND NOT g.took AND o.size > 0 AND abs(o.size - e.room) < e.room)
SELECT o.doc_id, o.size, o.ss AS source_size, o.target,
       ((o.whole + CASE WHEN o.size > 0 AND (o.bucket < o.cut OR o.bucket = o.cut AND (g.took OR x.i IS NOT NULL)) THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o LEFT JOIN g ON o.source IS NOT DISTINCT FROM g.source AND o.bucket = o.cut AND g.i = o.i
LEFT JOIN x ON o.source IS NOT DISTINCT FROM x.source AND o.bucket = o.cut AND x.i = o.i AND x.r = 1
""",
}
