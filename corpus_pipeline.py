"""From documents to packed token sequences: quality, near-duplicates, repeated strings, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import Scratch, tokenizer_file
from shardloom.llm.mixing import mix_sources
from shardloom.llm.near_dedup import near_duplicates
from shardloom.llm.packing import pack_documents
from shardloom.llm.quality import fit_quality, score_quality
from shardloom.llm.suffix_dedup import repeated_strings

#: Documents that score less than this are rejected.
LEAST_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have yet."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, doesn't reject.

    Each row goes by its text alone: null and empty texts are one empty passage, repeated rows go or stay together.
    """
    labels, score = spark.read.parquet(f"{sf_dir}/labels.parquet"), _free(docs, "_score")
    return score_quality(docs, fit_quality(docs, labels), score_col=score).where(F.col(score) >= LEAST_SCORE).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with the smallest id, its repeated rows once.

    Rows with one id and other texts are judged apart. Documents without words stay, repeated rows once; documents
    without an id all stay.
    """
    code = _free(docs, "_code")
    found = near_duplicates(docs).where("chosen and doc_id is not null").groupBy("doc_id", F.col("text_hash").alias(code)).agg(F.count("*").alias("rows"))
    found = Scratch(spark, "kept").keep(found)
    marked = docs.withColumn(code, F.xxhash64("text"))
    once = marked.join(found.where("rows = 1"), ["doc_id", code], "left_semi")
    again = marked.join(found.where("rows > 1"), ["doc_id", code], "left_semi").dropDuplicates(["doc_id", code])
    return once.unionByName(again).unionByName(marked.where("doc_id is null")).select(*(f"`{c}`" for c in docs.columns))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes that a document with a smaller id has too.

    Null texts stay null, a document that loses all is empty; rows with one id are one document; those without an id
    are left alone.
    """
    rows = repeated_strings(docs, length=50, keep_text=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources by target weights takes it; those taken no time go.

    Equal rows are counted together, so that they get their copies whichever of them is which; a null source is a
    source; documents without words come as often as their source is taken whole.
    """
    key = _free(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(*(f"`{c}`" for c in docs.columns)))
    plan = mix_sources(keyed, id_col=key).groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    plan = Scratch(spark, "plan").keep(plan.where("_all > 0"))
    taken = F.explode(F.expr("sequence(1L, p._all)"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]

    def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.alias("d").join(plan.alias("p"), F.col(f"d.{key}") == F.col(f"p.{key}")).select(*columns, taken.alias("_copy")).drop("_copy")

    repeated = keyed.join(plan.where("_rows > 1"), key, "left_semi").dropDuplicates([key])
    return copies(keyed, plan.where("_rows = 1")).unionByName(copies(repeated, plan.where("_rows > 1")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048 ids, filled with lexical neighbours; each row is a document, null texts are empty."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result being a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
