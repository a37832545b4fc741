"""WARC archives with a two-level capture index.

Records are gzip members, so each is read by a range read. The index sorts captures by reversed-host URL key into
compressed blocks of lines; each index file has a directory with the first key of its blocks, and a table of files
with their first and last keys stands above. A lookup finds the file, binary-searches the directory, reads one block,
and then the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch
from shardloom.llm.files import commit, covering, store

DATE = "2024-01-01T00:00:00Z"
#: Captures in one compressed block of the index.
BLOCK_LINES = 1000
#: Captures in one index file, blocks and captures for one task, and bytes of records for one task, about.
FILE_LINES = 200_000
CHUNK_BLOCKS = 50
TASK_LINES = 50_000
TASK_BYTES = 32 << 20
LEVEL = 3
CAPTURES = "key string, page_id long, url string, file string, at long, length long, digest string, kind string, refers_to long, payload_bytes long"
INDEX_FILES = "file string, part long, first_key string, last_key string, blocks long, lines long"


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: com,example,www)/path?query; lower-cased host without scheme, user and port 80 or 443."""
    rest = (url or "").strip().partition("://")[2] or (url or "").strip()
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].rpartition("@")[2].lower(), rest[cut:].partition("#")[0]
    host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{':' + port if port not in ('', '80', '443') else ''}){tail if tail.startswith('/') else '/' + tail}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, body: bytes, size: int, sha: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member: a response with its payload, or a revisit that names the response.

    ``size`` and ``sha`` are the whole payload's; a revisit has no ``body``.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of one record and its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http = rest[: int(fields["Content-Length"])]
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["X-Page-ID"]),
        "url": fields["WARC-Target-URI"],
        "kind": fields["WARC-Type"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "refers_to": number(fields.get("X-Refers-To-Page", "")),
        "payload": http.partition(b"\r\n\r\n")[2],
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        name, out, place = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            lines = []
            for page_id, url, payload, sha, size, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    out = at.open_output_stream(f"{root}/_{name}", compression=None)
                sha, kind = base64.b32encode(bytes.fromhex(sha)).decode(), "response" if refers_to is None else "revisit"
                member = record(page_id, url, payload or b"", size, sha, kind, refers_to)
                out.write(member)
                lines.append((surt(url), page_id, url, name, place, len(member), sha, kind, refers_to, size))
                place += len(member)
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i not in (1, 8) else pa.array(x, pa.int64()) for i, x in enumerate(map(list, zip(*lines, strict=True)))], names=[c.split()[0] for c in CAPTURES.split(", ")])
        if out is not None:
            out.close()
            commit(at, f"{root}/_{name}", f"{root}/{name}")

    return run


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        name, out, block, directory, place, n = f"captures-{uuid.uuid4().hex}", None, [], [], 0, 0

        def flush():
            nonlocal block, place
            data = zlib.compress("".join(f"{json.dumps(x)}\n" for x in block).encode(), LEVEL)
            out.write(data)
            directory.append([block[0][0], place, len(data)])
            place += len(data)
            block = []

        last = ""
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = at.open_output_stream(f"{root}/_{name}", compression=None)
                block.append(row)
                last, n = row[0], n + 1
                if len(block) >= BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            with at.open_output_stream(f"{root}/_{name}.dir", compression=None) as d:
                d.write(gzip.compress(json.dumps(directory).encode(), LEVEL))
            commit(at, f"{root}/_{name}.dir", f"{root}/{name}.dir")
            commit(at, f"{root}/_{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [TaskContext.get().partitionId()], "first_key": [directory[0][0]], "last_key": [last], "blocks": [len(directory)], "lines": [n]})

    return run


class CaptureFile:
    """One index file and its block directory."""

    def __init__(self, at, path: str):
        self.source = at.open_input_file(path)
        with at.open_input_file(f"{path}.dir") as d:
            self.directory = json.loads(gzip.decompress(d.read()))
        self._held: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list[list]:
        if self._held[0] != i:
            _, place, n = self.directory[i]
            self._held = (i, [json.loads(x) for x in zlib.decompress(self.source.read_at(n, place)).decode().split("\n")[:-1]])
        return self._held[1]

    def scan(self, lo: int = 0, hi: int | None = None) -> Iterator[list]:
        for i in range(lo, len(self.directory) if hi is None else min(hi, len(self.directory))):
            yield from self.block(i)

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key: binary search over the blocks' first keys, then within blocks."""
        for i in range(max(0, bisect_left(self.directory, key, key=lambda x: x[0]) - 1), len(self.directory)):
            if self.directory[i][0] > key:
                return
            rows = self.block(i)
            for row in rows[bisect_left(rows, key, key=lambda x: x[0]) :]:
                if row[0] != key:
                    return
                yield row


_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]
_KINDS = [pa.int64() if c.endswith(" long") else pa.string() for c in CAPTURES.split(", ")]


def _captures(folder: str, by_key: bool):
    """Captures of (file, first block) rows, or of (file, key) rows in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        name, file, rows = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name:
                    name, file = row[0], CaptureFile(at, f"{root}/{row[0]}")
                for x in file.find(row[1]) if by_key else file.scan(row[1], row[1] + CHUNK_BLOCKS):
                    rows.append(x)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    return run


def _surts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])


def _read(folder: str):
    """Range reads of the records of (file, at, length) rows, sorted by file; the payload of a revisit is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        name, source = None, None
        for batch in batches:
            rows, size = [], 0
            for file, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, at.open_input_file(f"{root}/{file}")
                x = parse(source.read_at(n, place))
                if x["kind"] == "revisit":
                    x["payload"] = None
                elif digest(x["payload"]) != x["digest"] or len(x["payload"]) != x["payload_bytes"]:
                    raise ValueError(f"{file} at {place}: the payload doesn't match its digest")
                rows.append(x)
                size += len(x["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
        if source is not None:
            source.close()

    return run


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD = "page_id long, url string, kind string, digest string, payload_bytes long, refers_to long, payload binary"


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the pages as WARC files with their capture index under ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest id is written as response
    and the others as revisits of it; of several rows with that id and payload the one with the least URL is the
    response. A row is judged by its own payload: an id's rows with other payloads are judged apart. Null payloads are
    empty, null URLs too; pages with a null id are responses unless an id has their payload. Other columns are ignored,
    whatever their names; a record holds one payload whole, however long; an empty table gives an archive without files.
    """
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    key = ["page_id", "sha", "n"]
    # digests travel, payloads don't: a payload's rows are counted by id
    counted = rows.select(*key).where(F.col("n") >= least_bytes).groupBy(*key).agg(F.count("*").alias("m"))
    groups = counted.groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.sum("m").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    marked = scratch.keep(counted.join(groups, ["sha", "n"]).where("page_id is null or page_id <> first or m > 1"))
    repeats = marked.where("page_id is null or page_id <> first").select(*key, F.col("first").alias("refers_to"))
    ties = marked.where("page_id = first").select(*key)
    joined = rows.join(repeats, rows.page_id.eqNullSafe(repeats.page_id) & (rows.sha == repeats.sha) & (rows.n == repeats.n), "left")
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")
    records = joined.select(rows.page_id, "url", body, rows.sha, rows.n, "refers_to")
    if ties.limit(1).count():
        tied = rows.join(ties, key, "left_semi")
        first = tied.groupBy(*key).agg(F.min(F.struct(F.coalesce("url", F.lit("")).alias("u"), "url")).alias("x"), F.first("payload").alias("payload"))
        response = first.select("page_id", F.col("x.url").alias("url"), "payload", "sha", "n", F.lit(None).cast("long").alias("refers_to"))
        again = tied.groupBy(*key, "url").agg(F.count("*").alias("m")).join(first.select(*key, "x"), key)
        again = again.withColumn("m", F.col("m") - F.col("url").eqNullSafe(F.col("x.url")).cast("int")).where("m > 0")
        again = again.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha", "n", F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("_i")).drop("_i")
        records = records.join(ties, key, "left_anti").select(*records.columns).unionByName(response).unionByName(again)
    captures = scratch.keep(records.mapInArrow(_write(path), CAPTURES))
    files = max(1, -(-captures.count() // FILE_LINES))
    ordered = captures.repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.mapInArrow(_index(path), INDEX_FILES).write.parquet(f"{path}/index")
    scratch.drop(marked, captures)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_FILES).parquet(f"{path}/index")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures, read from the blocks of the index."""
    chunks = _files(spark, path).select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(CHUNK_BLOCKS).cast("long"))).alias("lo"))
    return chunks.repartitionByRange(max(1, chunks.count()), "file", "lo").mapInArrow(_captures(path, False), CAPTURES)


def find_captures(path: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of the URLs in ``urls``: the file by its keys, the block by the directory, the line by its key.

    A key that is asked for repeatedly is looked up once, and all captures of it are returned; a null URL finds those
    of null URLs. Keys are dealt to tasks by ranges, so each task reads a run of blocks onwards.
    """
    files = _files(urls.sparkSession, path)
    keys = urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(_surts, "key string").distinct()
    asked = covering(keys, files)
    tasks = max(1, -(-(files.agg(F.sum("lines")).first()[0] or 0) // TASK_LINES))
    return asked.repartitionByRange(tasks, "key", "file").sortWithinPartitions("key", "file").mapInArrow(_captures(path, True), CAPTURES)


def read_records(path: str, captures: DataFrame) -> DataFrame:
    """The records of some captures, each by a range read of its archive file, checked against its digest."""
    places = Scratch(captures.sparkSession, "records").keep(captures.select("file", "at", "length"))
    tasks = max(1, -(-(places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    # a file's records are spread over tasks by ranges of its bytes, each task reading onwards
    return places.repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").mapInArrow(_read(path), RECORD)
