"""Files in the shared folder, opened by path in tasks whatever store they are in, and found by the keys they hold."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Files between two fences, the first keys that the driver holds to deal keys and files to buckets.
FILES_PER_FENCE = 8


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI (file:, hdfs:, s3:, gs: ...)."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def commit(at: fs.FileSystem, draft: str, final: str) -> None:
    """Gives a finished draft its name; a second attempt at the same task replaces the first one's file."""
    at.move(draft, final)


def _bucketed(df: DataFrame, columns: list[str], fences: list) -> DataFrame:
    """``df`` with the number of fences up to each of some key columns, as _b0, _b1 ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([bisect_right(fences, k) for k in batch.column(c).to_pylist()], pa.int32()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *(f"_b{i}" for i in range(len(found)))])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(f"_b{i}", IntegerType()) for i in range(len(columns)))]))


def covering(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(file, key): for each row of ``asked`` (key, not null) the files whose first_key to last_key has it.

    ``files`` (file, part, first_key, last_key; part ascends with the keys) don't overlap but at their ends. Keys and
    files meet by equal buckets between fences, so no key is compared with more than a few files.
    """
    some = files.where(F.col("part") % FILES_PER_FENCE == 0).select("first_key")
    fences = sorted(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in some.collect())  # one for FILES_PER_FENCE files
    spans = _bucketed(files.select("file", "first_key", "last_key"), ["first_key", "last_key"], fences)
    spans = spans.withColumn("_b", F.explode(F.sequence("_b0", "_b1"))).drop("_b0", "_b1")
    keys = _bucketed(asked.select("key"), ["key"], fences).withColumnRenamed("_b0", "_b")
    return keys.join(spans, "_b").where("key >= first_key and key <= last_key").select("file", "key")
