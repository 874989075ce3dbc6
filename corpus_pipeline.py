"""A training-corpus pipeline over ``documents``: quality, exact and near dedup, mixing, packing."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm._common import shared_folder
from ledgerlark.llm.exact_dedup import exact_dedup
from ledgerlark.llm.minhash import near_duplicates
from ledgerlark.llm.mixing import mixed_documents
from ledgerlark.llm.packing import pack
from ledgerlark.llm.quality import fit, keep_good
from ledgerlark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents and the labels outside the held-out fold, scores 0.7 or more."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _staying(docs: DataFrame, verdicts: DataFrame, text_key: Column) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (``doc_id``, a key of the text, ``kept``) keep, one of rows that repeat an id and a text.

    A row is known by its id and its text's key, so rows of one id with different texts each have their own verdict.
    """
    key = lambda of: F.concat_ws(":", F.col("doc_id").cast("string"), of.cast("string"))  # noqa: E731  one column, so that the join's exchange serves the window too
    kept = verdicts.where("kept").toDF("doc_id", "_text", "_kept").select(key(F.col("_text")).alias("_key")).distinct()
    rows = docs.withColumn("_key", key(text_key)).join(kept, "_key")
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))).where("_nth = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z; null ids go after all others."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return _staying(docs, exact_dedup(docs).select("doc_id", "text_sha256", "kept"), F.sha2(lower.cast("binary"), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return _staying(docs, near_duplicates(docs).select("doc_id", "text_hash", "kept"), F.xxhash64(F.coalesce("text", F.lit(""))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document appears once for each round of its source, the last time with its words in taken blocks."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents in sequences of 1024 tokens; a document that the mix repeats is packed each time."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: No SQL: trained scores, sampled bands and tokenizer ids are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A run that is given the ``run_id`` of one that was broken off goes on after its last finished stage.
    """
    folder = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, stage in STAGES[:-1]:
        mark = done(f"{folder}/{name}/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
