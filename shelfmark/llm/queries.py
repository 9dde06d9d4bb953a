"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    cross_parsing,
    feistel_shards,
    grid_order_join,
    importance_resampling,
    latent_decontam,
    paragraph_minhash,
    spelling_variants,
    swap_packing,
    token_counts,
    token_packing,
    toxic_segments,
    vantage_simhash,
    zstd_quality,
)
from shelfmark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str):
    """Register ``fn(table)``, where ``table(name)`` reads one of the supplied tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session = configure(spark)
            return fn(lambda table: session.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        return fn

    return register


@query("op1_language")
def _(table):
    return cross_parsing.identify(table("documents"))


@query("op2_quality")
def _(table):
    return zstd_quality.classify(table("documents"), table("labels"))


@query("op3_packed_matrices")
def _(table):
    return token_packing.packed_matrices(table("documents"), tokenizer())


@query("op4_sharding")
def _(table):
    placed = feistel_shards.shard_rows(table("documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op5_toxicity")
def _(table):
    found = toxic_segments.classify(table("documents"), table("labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query("op6_paragraphs")
def _(table):
    found = paragraph_minhash.repeated_passages(table("documents"))
    return found.select("doc_id", "para", "place", "start", "end", "words", "keeper_doc_id", "keeper_place", "kept")


@query("op7_embeddings")
def _(table):
    return grid_order_join.near_duplicates(table("embeddings"))


@query("op8_simhash")
def _(table):
    return vantage_simhash.near_duplicates(table("documents"))


@query("op9_packing")
def _(table):
    return swap_packing.pack_documents(table("documents"), tokenizer())


@query("op10_decontamination")
def _(table):
    return latent_decontam.contaminated(table("documents"), table("benchmark"))


@query("op11_spelling_variants")
def _(table):
    return spelling_variants.spelling_variants(table("documents"))


@query("op12_importance_resampling")
def _(table):
    return importance_resampling.resample(table("documents"), table("benchmark"))


@query("op13_token_counts")
def _(table):
    return token_counts.token_counts(table("documents"), tokenizer())
