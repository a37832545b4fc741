"""Removal of byte strings that an earlier document has too, by run-length compressed index.

Anchors (grams that equal strings choose alike) bring together the places that may share a long string. Places whose
whole surroundings equal those of an earlier document are covered at once; the first documents of different
surroundings of one anchor meet in a run-length compressed Burrows-Wheeler index of bounded size, through which their
matching statistics stream. An anchor that has too many kinds of surroundings for one index is split by the bytes before
and after it, and what is still too many is settled by its whole strings, grouped by Spark. Anchors that a sample of the
texts shows to be very frequent are split by their surroundings before they are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.anchors import GRAM, anchors, gram_hashes
from shardloom.llm.common import Scratch
from shardloom.llm.run_index import RunLengthIndex
from shardloom.llm.textbytes import SMALL_SLICE, mix, prefix_hashes, slices, span_hashes

#: Anchors that one task groups at a time, about, and bytes in one index, about.
BUCKET_ANCHORS = 500_000
INDEX_BYTES = 1 << 20
#: An anchor with more kinds of surroundings than this is split.
HOT_KINDS = 4096
#: An anchor with more places than this, by a sample of SAMPLE_BYTES or a hundredth of the texts, is split before it is grouped.
HOT_PLACES = 200_000
SAMPLE_BYTES = 8 << 20
_PLACE = np.dtype([("h", "<u4"), ("doc", "<i8"), ("pos", "<i4"), ("kind", "<u8")])
SPANS = "doc_id long, covered binary, tests binary, hot binary"


def _places(column: pa.Array, use: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, row, place, hash) of the anchors in runs of rows of a batch."""
    for first, data, offsets in slices(column, SMALL_SLICE):
        hashes, rows, places = gram_hashes(data), [], []
        for i in range(len(offsets) - 1):
            if use[first + i]:
                p = anchors(hashes[offsets[i] : max(offsets[i], offsets[i + 1] - GRAM + 1)], length)
                places.append(p)
                rows.append(np.full(len(p), i))
        if rows and sum(map(len, rows)):
            row, pos = np.concatenate(rows), np.concatenate(places)
            yield first, data, offsets, row, pos, mix(hashes[offsets[row] + pos])


def _frequent(length: int):
    """(anchor, places) of those that occur more than once in a batch of sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h in _places(batch.column(0), np.ones(len(batch), bool), length):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    return run


def _anchors(length: int, buckets: int, frequent: np.ndarray):
    """For each batch the anchors of its texts, packed by bucket: (bucket, h, doc, pos, kind).

    An anchor that several documents of a batch have with the same surroundings goes to its bucket once, with the
    first document; the others are covered and said to be so in buckets of their own (below 0). Frequent anchors go to
    buckets by anchor and surroundings (from ``buckets`` on).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.array(batch.column(0).is_null().to_numpy(zero_copy_only=False), bool)
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            for first, data, offsets, row, pos, h in _places(batch.column(1), ~null, length):
                lo, hi = np.maximum(pos - (length - GRAM), 0), np.minimum(pos + length, np.diff(offsets)[row])
                kind = span_hashes(prefix_hashes(data), offsets[row] + lo, offsets[row] + hi) ^ mix((pos - lo).astype(np.uint64))
                x = np.zeros(len(row), _PLACE)
                x["h"], x["doc"], x["pos"], x["kind"] = (h >> np.uint64(32)).astype(np.uint32), ids[first + row], pos, kind
                bucket = _bucket(h, buckets)
                if len(frequent):
                    often = np.isin(h, frequent)
                    bucket[often] = buckets + (mix(h[often] ^ kind[often]) % np.uint64(buckets)).astype(np.int64)
                # by surroundings, then document: in a batch, equal surroundings are of one anchor
                order = np.lexsort((x["doc"], kind))
                same = np.r_[False, kind[order][1:] == kind[order][:-1]]
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = np.zeros(len(order), bool)
                later[order] = x["doc"][order] > x["doc"][order][head]
                bucket[later] = -1
                order = np.argsort(bucket, kind="stable")
                x, bucket = x[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                keys, ends = bucket[np.r_[0, cuts]], np.r_[0, cuts, len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(keys < 0, -1 - int(ids[first]) % buckets, keys)), _binaries(x, ends)], ["bucket", "places"])

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets


def _binaries(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array's items, between ``ends``, as binary values."""
    offsets = (np.asarray(ends, np.int64) * x.dtype.itemsize * int(np.prod(x.shape[1:]))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _grouped(length: int, hot_kinds: int, buckets: int, frequent: np.ndarray):
    """Per document: covered places, places to test (bucket anchor, start), and those of hot anchors."""
    of_frequent = dict(zip((frequent >> np.uint64(32)).tolist(), _bucket(frequent, buckets).tolist(), strict=True))

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        x = np.concatenate([np.frombuffer(b.as_py(), _PLACE) for b in table.column("places")])
        test = hot = np.zeros(len(x), bool)
        if bucket < 0:
            covered = np.ones(len(x), bool)
        else:
            x = x[np.lexsort((x["doc"], x["kind"], x["h"]))]
            new_h = np.r_[True, x["h"][1:] != x["h"][:-1]]
            new_kind = new_h | np.r_[True, x["kind"][1:] != x["kind"][:-1]]
            head = np.maximum.accumulate(np.where(new_kind, np.arange(len(x)), 0))
            covered = x["doc"] > x["doc"][head]
            if bucket >= buckets:  # frequent anchors: their other surroundings are elsewhere
                test = hot = ~covered
            else:
                group = np.cumsum(new_h) - 1
                kinds = np.bincount(group, new_kind).astype(np.int64)
                low, high = np.minimum.reduceat(x["doc"], np.flatnonzero(new_h)), np.maximum.reduceat(x["doc"], np.flatnonzero(new_h))
                test = ~covered & ((kinds > 1) & (low != high))[group]
                hot = test & (kinds > hot_kinds)[group]
        use = covered | test
        x, covered, test, hot = x[use], covered[use], test[use], hot[use]
        order = np.argsort(x["doc"], kind="stable")
        x, covered, test, hot = x[order], covered[order], test[order], hot[order]
        starts = np.flatnonzero(np.r_[True, np.diff(x["doc"]) != 0]) if len(x) else np.zeros(0, np.int64)
        if bucket < buckets:
            key = (np.int64(max(bucket, 0)) << 32) + x["h"].astype(np.int64)
        else:
            key = np.array([of_frequent[h] << 32 | h for h in x["h"].tolist()], np.int64)
        tests = np.stack([key, x["pos"].astype(np.int64)], axis=1).astype("<i8")
        out = [pa.array(x["doc"][starts].astype(np.int64))]
        for data, mask in ((x["pos"].astype("<i4"), covered), (tests, test & ~hot), (tests, hot)):
            before = np.r_[0, np.cumsum(mask)]
            out.append(_binaries(data[mask], before[np.r_[starts, len(x)]] if len(x) else np.zeros(1, np.int64)))
        return pa.table(out, names=["doc_id", "covered", "tests", "hot"])

    return run


def _pairs(parts: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts or [] if p), "<i8").reshape(-1, 2)


def _surroundings(length: int, shards: int):
    """(hot, shard, anchor, doc_id, start, place of the anchor in the bytes, bytes) of the places to test.

    A place of a hot anchor comes twice, under its anchor with half of the bytes before it and with half of those after
    it; a string that holds the anchor holds one of the halves too.
    """
    side, half = length - GRAM, (length - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                rows: list[tuple] = []
                part = batch.slice(lo, 500)
                for doc_id, data, tests, hots in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    for hot, key, pos in [(h, *x) for h, parts in ((False, tests), (True, hots)) for x in _pairs(parts).tolist()]:
                        start = max(0, pos - side)
                        keys = [key]
                        if hot:
                            ends = [(b"<", data[pos - half : pos])] * (pos >= half) + [(b">", data[pos + GRAM : pos + GRAM + half])] * (pos + GRAM + half <= len(data))
                            keys = [int.from_bytes(hashlib.blake2b(x, digest_size=8, key=where + key.to_bytes(8, "little")).digest(), "little", signed=True) for where, x in ends]
                        rows += [(hot, k % shards, k, doc_id, start, pos - start, data[start : pos + length]) for k in keys]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows, strict=True))], ["hot", "shard", "anchor", "doc_id", "start", "at", "bytes"])

    return run


def _matched(length: int):
    """Spans of each place's surroundings that an earlier document of the shard has, by matching statistics."""

    def spans(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        docs, starts, texts = (table.column(c).to_pylist() for c in ("doc_id", "start", "bytes"))
        doc = np.array(docs, np.int64)
        if not texts:
            return
        lengths = np.array(list(map(len, texts)))
        index = RunLengthIndex(texts, length)  # rows come in document order: the least owner is the earliest
        for lo in range(0, len(texts), 4096):
            part = texts[lo : lo + 4096]
            found, rows = index.matching_statistics(part)
            lane, at = np.nonzero(found >= length)
            earlier = doc[index.least_owner(rows[lane, at])] < doc[lo + lane]
            lane, at = lane[earlier], at[earlier] - (found.shape[1] - lengths[lo + lane[earlier]])
            for i, a, b in _runs(lane, at):
                start = starts[lo + i] + a
                yield docs[lo + i], np.array([start, starts[lo + i] + b + length], "<i8").tobytes()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        keys, at = mix(table.column("anchor").to_numpy().astype(np.uint64)), table.column("at").to_numpy()
        alike, row = np.zeros(len(table), bool), 0
        code = [np.zeros(len(table), np.uint64) for _ in range(2)]
        full = [np.zeros(len(table), bool) for _ in range(2)]
        for chunk in table.column("bytes").chunks:
            for first, data, offsets in slices(chunk, SMALL_SLICE):
                here, n = slice(row + first, row + first + len(offsets) - 1), np.diff(offsets)
                prefix = prefix_hashes(data)
                # of the bytes around the anchor, half of those before or after it must be elsewhere too
                for k, (lo, hi) in enumerate(((at[here] - half, at[here] + GRAM), (at[here], at[here] + GRAM + half))):
                    full[k][here] = (lo >= 0) & (hi <= n)
                    code[k][here] = span_hashes(prefix, offsets[:-1] + np.clip(lo, 0, n), offsets[:-1] + np.clip(hi, 0, n)) ^ keys[here]
            row += len(chunk)
        for k in range(2):
            _, inverse, count = np.unique(code[k], return_inverse=True, return_counts=True)
            alike |= full[k] & (count[inverse] > 1)
        found = list(spans(table.filter(pa.array(alike))))
        return pa.table([pa.array([d for d, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["doc_id", "spans"])

    half = (length - GRAM) // 2

    return run


def _runs(lane: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(lane, first, last) of runs of consecutive places."""
    if len(lane):
        cut = np.flatnonzero((np.diff(lane) != 0) | (np.diff(at) != 1)) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(lane)], strict=True):
            yield int(lane[a]), int(at[a]), int(at[b - 1])


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                rows = [
                    (doc_id, start + i, data[i : i + length])
                    for doc_id, start, data in zip(*(batch.slice(lo, 500).column(c).to_pylist() for c in ("doc_id", "start", "bytes")), strict=True)
                    for i in range(len(data) - length + 1)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows, strict=True))], ["doc_id", "start", "window"])

    return run


def _cut(keep_text: bool, length: int):
    """n_bytes, removed spans' number and bytes, and the remaining bytes' digest (and text)."""
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, len(b), 500)):
            rows = []
            for doc_id, text, places, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):  # others are carried
                data = (text or "").encode()
                spans = _pairs(parts)
                if places:
                    pos = np.frombuffer(b"".join(places), "<i4").astype(np.int64)
                    spans = np.concatenate([spans, np.stack([np.maximum(pos - side, 0), pos + length], axis=1)])
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                kept, removed, n, at, last = [], 0, 0, 0, -1
                for a, b in spans.tolist():
                    b = min(b, len(data))
                    if a > last:
                        n += 1
                    last = max(last, b)
                    if a > at:
                        kept.append(data[at:a])
                    removed += max(0, b - max(a, at))
                    at = max(at, b)
                kept.append(data[at:])
                rest = b"".join(kept)
                row = (doc_id, len(data), removed, n, hashlib.sha256(rest).hexdigest())
                rows.append((*row, text if text is None or not n else rest.decode("utf-8", "ignore")) if keep_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][: 6 if keep_text else 5]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)) if rows else [[]] * len(names), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[4:]], [*names, *batch.schema.names[4:]])

    return run


def repeated_strings(docs: DataFrame, length: int = 50, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", hot_kinds: int = HOT_KINDS, hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``keep_text`` also text, what is left, and row, its other columns.

    Of a text's UTF-8 bytes those go that lie in a string of ``length`` bytes (36 to 56) that starts in a document
    with a smaller id too; all strings are judged on the input. Matches never cross documents, and rows with the same
    id are one document. Null texts are empty; a row with a null id neither removes nor loses anything. What is left
    as text drops bytes of a character that a cut has split. A very long text is judged whole; an empty table gives an
    empty result. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(size * 2 / (length - GRAM + 2) / BUCKET_ANCHORS))
    share = min(1.0, max(0.01, SAMPLE_BYTES / max(1, size)))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    often = sample.mapInArrow(_frequent(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > hot_places * share)
    # an anchor has a place for some 13 bytes: at most one for 13 * hot_places bytes of all texts is frequent
    frequent = np.sort(np.array([r.h for r in often.select("h").collect()], np.int64)).view(np.uint64)
    packed = rows.mapInArrow(_anchors(length, buckets, frequent), "bucket long, places binary")
    found = scratch.keep(packed.groupBy("bucket").applyInArrow(_grouped(length, hot_kinds, buckets, frequent), SPANS))

    asked = found.where((F.octet_length("tests") > 0) | (F.octet_length("hot") > 0)).groupBy("doc_id").agg(F.collect_list("tests").alias("tests"), F.collect_list("hot").alias("hot"))
    sums = asked.agg(F.sum(F.aggregate("tests", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)))).first()[0] or 0
    shards = max(1, round(sums / 16 * (2 * length - GRAM) / INDEX_BYTES))
    texts = rows.join(asked, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "tests", "hot")
    # whole texts meet their places once, for hot anchors and for others
    places = texts.mapInArrow(_surroundings(length, shards), "hot boolean, shard long, anchor long, doc_id long, start long, at long, bytes binary")
    places = scratch.keep(places)
    tests, hot = places.where("not hot").drop("hot"), places.where("hot").drop("hot")
    matched = scratch.keep(tests.groupBy("shard").applyInArrow(_matched(length), "doc_id long, spans binary"))
    none = F.lit(None).cast("binary")
    spans = matched
    if found.where(F.octet_length("hot") > 0).limit(1).count():
        kinds = scratch.keep(hot.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
        some = kinds.where(F.col("n") <= hot_kinds)
        shards = max(1, round((some.agg(F.sum("n")).first()[0] or 0) * (2 * length - GRAM) / INDEX_BYTES))
        tests = hot.join(some, "anchor").select(F.pmod("anchor", F.lit(shards)).alias("shard"), "anchor", "doc_id", "start", "at", "bytes")
        spans = spans.union(tests.groupBy("shard").applyInArrow(_matched(length), "doc_id long, spans binary"))
        windows = hot.join(kinds.where(F.col("n") > hot_kinds), "anchor").select("doc_id", "start", "bytes").distinct()
        windows = scratch.keep(windows.mapInArrow(_windows(length), "doc_id long, start long, window binary"))
        least = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window", "least")
        late = windows.join(least, "window").where("doc_id > least").select("doc_id", "start")
        number = lambda c: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8))))
        spans = spans.union(late.select("doc_id", F.concat(number(F.col("start")), number(F.col("start") + length)).alias("spans")))
    covered = found.where(F.octet_length("covered") > 0).select("doc_id", "covered", none.alias("spans"))
    spans = covered.union(spans.select("doc_id", none.alias("covered"), "spans"))
    spans = spans.groupBy("doc_id").agg(F.collect_list("covered").alias("covered"), F.collect_list("spans").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not keep_text:
        return rows.join(spans, "doc_id", "left").select("doc_id", "text", "covered", "spans").mapInArrow(_cut(False, length), schema)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), others).join(spans, "doc_id", "left").select("doc_id", "text", "covered", "spans", "row")
    return whole.mapInArrow(_cut(True, length), f"{schema}, text string, row {whole.schema['row'].dataType.simpleString()}")
