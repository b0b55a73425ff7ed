"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

quality rules -> MinHash near-duplicates -> repeated passages -> benchmark passages -> BPE ids. Each stage works on all its
predecessor kept and returns the columns of documents, but the last, which returns the encoded documents. Null and empty
texts and those under 50 words end in the first stage; texts that later stages empty stay as rows without words; of rows
that tie as near copies the least doc_id stays, with rows that repeat it whole; a very long text goes through whole, in
parts; extra columns are carried up to the last stage, also those named like a stage's own, which give way inside it and
are named back; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import benchmark_filter, bpe, near_dedup, quality, substring_dedup
from quillspark.llm.common import BATCH_ROWS, drop_tables, write_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id. Rows that repeat it whole stay with it."""
    gone = near_dedup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone"), "tkey").distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("_gone")) & (F.xxhash64(docs.text) == gone.tkey), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has."""
    return _counted(substring_dedup.remove(docs), docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return _counted(benchmark_filter.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number and digests of its ids, and of their decoded text."""
    return bpe.digests(docs)


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*columns)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _staged(stage: Stage) -> Stage:
    """The stage in a session of small Arrow batches, where it keeps Spark's default: rows are whole texts. A stage's result is only
    computed when its caller writes it, so a stage that is called alone leaves the setting to its caller; run() puts it back."""

    @wraps(stage)
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(ARROW_ROWS) == "10000":
            spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return apply


STAGES = [
    ("quality_rules", _staged(quality_rules)),
    ("near_duplicates", _staged(near_duplicates)),
    ("repeated_passages", _staged(repeated_passages)),
    ("benchmark_passages", _staged(benchmark_passages)),
    ("bpe_ids", _staged(bpe_ids)),
]

#: Tokeniser measures and BPE ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents that are left; of the tables written on the way only the last stays."""
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(ARROW_ROWS)
    try:
        for name, stage in STAGES:
            before = set(written(spark))
            out = write_table(spark, stage(spark, docs, sf_dir), name)
            drop_tables(spark, *[t for t in written(spark) if t not in before and t != out._quill_path], *([docs] if hasattr(docs, "_quill_path") else []))
            docs = out
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return docs
