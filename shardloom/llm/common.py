"""What the operators share: intermediate tables in the cluster's shared folder and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.sources.tables import work_folder


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file, which every node has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive lost executors.

    ``keep`` writes a DataFrame and reads it back, ``drop`` deletes tables that are no longer needed; what is left
    goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = work_folder(spark, name)
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._n = 0
        self._at: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at.pop(id(t))), True)

    def clear(self, *but: DataFrame) -> None:
        """Deletes all tables but those given."""
        for key, path in list(self._at.items()):
            if key not in {id(t) for t in but}:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
                del self._at[key]


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long), component being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as joins and grouped minima, so that no node's
    neighbours are gathered in one place; each step is a table in the shared folder. Ends when all components are stars around their smallest nodes.
    """
    now = scratch.keep(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        # settled: each node has one neighbour, which has none itself
        heads = now.select(F.col("b").alias("a"), F.lit(True).alias("head")).distinct()
        if not now.groupBy("a").agg(F.count("*").alias("n")).join(heads, "a", "left").where("n > 1 or head").limit(1).count():
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.keep(small)
        scratch.drop(now)
        now = after
    roots = now.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return now.union(roots).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
