"""A corpus pipeline: quality, near-duplicate documents, repeated paragraphs, benchmark passages, packing.

Every stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import latent_decontam, paragraph_minhash, swap_packing, vantage_simhash, zstd_quality
from shelfmark.llm.base import stored
from shelfmark.llm.queries import tokenizer
from shelfmark.session import configure

#: SQL expresses neither compression nor tokenization; tests hold the stages against brute force.
ORACLE_SQL = None


def configured(stage):
    """A stage under the library's settings, whoever calls it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


@configured
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier does not reject, that is those with a score of 0.5 or more."""
    model = zstd_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = zstd_quality.score(docs, model, keep=docs.columns, name="quality_score_of_row")
    return scored.where(F.col("quality_score_of_row") >= 0.5).select(*docs.columns)


@configured
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link at four or fewer bits."""
    return vantage_simhash.without_near_duplicates(docs).select(*docs.columns)


@configured
def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document or place has alike or nearly so."""
    return paragraph_minhash.without_repeats(docs)


@configured
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents into which no benchmark item has leaked."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = latent_decontam.leaks(docs, items, docs.columns, "leaks_of_row")
    return found.where(F.size("leaks_of_row") == 0).select(*docs.columns)


@configured
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of what is left."""
    # its workers still hold what the other stages needed
    return swap_packing.pack_documents(docs, tokenizer(), remembered=150_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_paragraphs", repeated_paragraphs),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
