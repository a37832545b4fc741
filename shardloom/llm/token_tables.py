"""Token ids in sorted-string-table files: documents by identifier, found by binary search.

A file holds a run of ascending keys. Data blocks keep keys prefix-compressed between restart points and end with the
restarts; a sparse index has the last key of each block and the ids before it; a Bloom filter over the keys and a fixed
footer follow. The manifest, a Parquet table, has a row for each file with its first and last key, so a lookup opens
one file, asks its filter, and reads one block.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch
from shardloom.llm.files import commit, covering, store
from shardloom.llm.textbytes import mix
from shardloom.llm.tokens import encoder

MAGIC = b"SLTABLE1"
FOOTER = struct.Struct("<QQQQQQB8s")  # index at, index bytes, filter at, filter bytes, documents, ids, bytes of an id, magic
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS, PROBES = 10, 7
#: Blocks that one task reads, and bytes of files for one task of lookups, about.
CHUNK_BLOCKS = 256
TASK_BYTES = 16 << 20
MANIFEST = "file string, part long, first_key binary, last_key binary, n_docs long, n_ids long, n_bytes long, n_blocks long"
DOCUMENTS = "doc_id long, start long, ids binary"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([int.from_bytes(k[-8:], "big") ^ len(k) << 56 for k in keys], np.uint64)
    one, two = mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (one[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * two[:, None]) % np.uint64(bits)


class TableWriter:
    """Writes one file; keys must come in ascending order (equal ones may follow each other)."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.index, self.keys, self.n_ids, self.before = [], [], 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.id_bytes == 2 else "<u4").tobytes()
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block, self.n_ids = key, self.in_block + 1, self.n_ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), self.before))
            self.at += len(data)
            self.block, self.restarts, self.in_block, self.before = bytearray(), [], 0, self.n_ids

    def close(self) -> int:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(before) for k, at, n, before in self.index)
        bits = max(64, -(-BITS * len(self.keys) // 8) * 8)
        grid = np.zeros(bits, np.uint8)
        for lo in range(0, len(self.keys), 1 << 16):
            grid[_probes(self.keys[lo : lo + (1 << 16)], bits)] = 1
        filt = np.packbits(grid).tobytes()
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(filt), len(self.keys), self.n_ids, self.id_bytes, MAGIC)
        self.out.write(index + filt + foot)
        return self.at + len(index) + len(filt) + len(foot)


class TableReader:
    """Reads one file: blocks of it in order, or the documents of keys."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, n, fat, fn, self.n_docs, self.n_ids, self.id_bytes, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.filter = np.frombuffer(source.read_at(fn, fat), np.uint8)
        raw, self.index, i = source.read_at(n, at), [], 0
        while i < len(raw):
            k, i = _read_varint(raw, i)
            key, i = raw[i : i + k], i + k
            where, i = _read_varint(raw, i)
            length, i = _read_varint(raw, i)
            before, i = _read_varint(raw, i)
            self.index.append((key, where, length, before))
        self._held: tuple = (-1, [], [])

    def _entries(self, data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + n]
            at += n

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...], int]:
        data = self.source.read_at(self.index[i][2], self.index[i][1])
        n = struct.unpack("<I", data[-4:])[0]
        end = len(data) - 4 - 4 * n
        return data, struct.unpack(f"<{n}I", data[end:-4]), end

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def scan(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in the file, ids) of the documents in some blocks."""
        for i in range(lo, len(self.index) if hi is None else min(hi, len(self.index))):
            data, _, end = self._block(i)
            start = self.index[i][3]
            for key, value in self._entries(data, 0, end):
                ids = self.ids(value)
                yield id_of(key), start, ids
                start += len(ids)

    def may_have(self, keys: list[bytes]) -> np.ndarray:
        """Whether the filter lets each key pass."""
        if not keys:
            return np.zeros(0, bool)
        probes = _probes(keys, len(self.filter) * 8).astype(np.int64)
        return (self.filter[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8) & 1).all(axis=1)

    def find(self, key: bytes) -> Iterator[np.ndarray]:
        """The ids of every document of one key: filter, then binary search over blocks and restarts."""
        if not self.may_have([key])[0]:
            return
        for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            data, restarts, end = self._block(i)
            first = [next(self._entries(data, r, end))[0] for r in restarts]
            start = restarts[max(0, bisect_left(first, key) - 1)]
            for k, value in self._entries(data, start, end):
                if k > key:
                    return
                if k == key:
                    yield self.ids(value)

    def find_sorted(self, keys: list[bytes]) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the file, ids) of every document of ascending keys.

        Filter, then binary search over the sparse index and in the block, which is read once for keys that share it.
        """
        for key in (k for k, may in zip(keys, self.may_have(keys).tolist(), strict=True) if may):
            for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
                if self._held[0] != i:
                    data, _, end = self._block(i)
                    entries = list(self._entries(data, 0, end))
                    size = np.array([len(v) for _, v in entries], np.int64) // self.id_bytes
                    self._held = (i, entries, (self.index[i][3] + np.cumsum(size) - size).tolist())
                _, entries, starts = self._held
                at = bisect_left(entries, key, key=lambda x: x[0])
                while at < len(entries) and entries[at][0] == key:
                    yield key, starts[at], self.ids(entries[at][1])
                    at += 1
                if at < len(entries):
                    break


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        writer, name, first = None, f"run-{uuid.uuid4().hex}.slt", b""
        coder = encoder(tokenizer)
        width = 2 if coder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.batch(batch.column(1)), strict=True):
                key = key_of(doc_id)
                if writer is None:
                    out = at.open_output_stream(f"{root}/_{name}", compression=None)
                    writer, first = TableWriter(out, width), key
                writer.add(key, np.concatenate([ids, end]))
        if writer is not None:
            last = writer.keys[-1]
            size = writer.close()
            out.close()
            commit(at, f"{root}/_{name}", f"{root}/{name}")
            row = {"file": [name], "part": [TaskContext.get().partitionId()], "first_key": [first], "last_key": [last], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids], "n_bytes": [size], "n_blocks": [len(writer.index)]}
            yield pa.RecordBatch.from_pydict(row)

    return run


def write_tables(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token ids of every document under ``path`` and returns the manifest.

    Files hold ascending ranges of ids (null first); an id's rows are in one file, all kept, equal texts next to each
    other. Null and empty texts have the end id only; a long text is an entry of its own length, in a block of its own
    if it is longer than one; an empty table gives an empty manifest. Other columns of ``docs`` are ignored, whatever
    their names. A task that runs again writes a file of its own, and only the files of tasks that counted are in the
    manifest.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_write(path, tokenizer, end_id), MANIFEST).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files in key order, ``base`` being the ids of all files before one."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    order = Window.orderBy("part")  # one row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class _Documents:
    """Batches of (doc_id, start, ids), given out when they hold enough."""

    def __init__(self):
        self.rows: tuple[list, list, list] = ([], [], [])
        self.size = 0

    def add(self, doc_id: int | None, start: int, ids: np.ndarray) -> bool:
        for held, x in zip(self.rows, (doc_id, start, ids.tobytes()), strict=True):
            held.append(x)
        self.size += len(self.rows[2][-1])
        return self.size > 4 << 20

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.rows[0], pa.int64()), pa.array(self.rows[1], pa.int64()), pa.array(self.rows[2], pa.binary())], ["doc_id", "start", "ids"])
        self.rows, self.size = ([], [], []), 0
        return out


def _scan(folder: str):
    """The documents of (file, base, first block) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        out = _Documents()
        for batch in batches:
            for name, base, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with at.open_input_file(f"{root}/{name}") as source:
                    for doc_id, start, ids in TableReader(source).scan(lo, lo + CHUNK_BLOCKS):
                        if out.add(doc_id, base + start, ids):
                            yield out.take()
        yield out.take()

    return run


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian 32-bit) of every document, by ranges of blocks."""
    files = read_manifest(spark, path)
    chunks = files.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(CHUNK_BLOCKS).cast("long"))).alias("lo"))
    return chunks.repartitionByRange(max(1, chunks.count()), "base", "lo").mapInArrow(_scan(path), DOCUMENTS)


def _find(folder: str):
    """The documents of (file, base, key) rows in ascending order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = store(folder)
        name, source, reader, out = None, None, None, _Documents()
        for batch in batches:
            names, bases, keys = (c.to_pylist() for c in batch.columns)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if names[lo] != name:
                    if source is not None:
                        source.close()
                    name, source = names[lo], at.open_input_file(f"{root}/{names[lo]}")
                    reader = TableReader(source)
                for key, start, ids in reader.find_sorted(keys[lo:hi]):
                    if out.add(id_of(key), bases[lo] + start, ids):
                        yield out.take()
        yield out.take()
        if source is not None:
            source.close()

    return run


def lookup(path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, ids of the documents whose ids are in ``wanted`` (null finds null ids), by binary search in the files.

    An id that is asked for repeatedly is looked up once; each stored document of an id is returned; an id that no
    file has gives nothing. Keys are dealt to tasks by ranges, so each task reads a run of blocks onwards.
    """
    spark = wanted.sparkSession
    scratch = Scratch(spark, "lookup")
    files = scratch.keep(read_manifest(spark, path))
    key = F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00"))).otherwise(
        F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    )
    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct().select(key.alias("key"))
    hit = covering(asked, files).join(files.select("file", "base"), "file").select("file", "base", "key")
    tasks = max(1, -(-(files.agg(F.sum("n_bytes")).first()[0] or 0) // TASK_BYTES))
    return hit.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(_find(path), DOCUMENTS)
