"""Embedding each distinct content once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.config import EngineConfig
from veinstone.functions.vectors import feature_hash_embedding


def missing_contents(chunks: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Distinct contents (by hash) that have no vector of this space yet."""
    known = cache.filter(F.col("embedding_fingerprint") == fingerprint).select("content_hash")
    return chunks.groupBy("content_hash").agg(F.any_value("content").alias("content")).join(
        known, "content_hash", "left_anti")


def embed_missing(chunks: DataFrame, cache: DataFrame, config: EngineConfig,
                  embed=feature_hash_embedding) -> DataFrame:
    """New cache rows (content_hash, embedding_fingerprint, embedding, dimensions, checksum).

    ``embed`` is the model port: a function of (text column, dimensions).
    Rows of another length than configured are refused.
    """
    new = missing_contents(chunks, cache, config.embedding_fingerprint)
    vectors = new.withColumn("embedding", embed(F.col("content"), config.embedding_dimensions))
    size = F.size("embedding")
    checked = F.when(size == config.embedding_dimensions, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit("embedding dimension mismatch: "), size.cast("string"))))
    return vectors.select(
        "content_hash", F.lit(config.embedding_fingerprint).alias("embedding_fingerprint"),
        checked.alias("embedding"), size.alias("dimensions"),
        F.sha2(F.array_join("embedding", ","), 256).alias("checksum"))


def attach_embeddings(chunks: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Chunks with their vector, null where there is none; status per chunk."""
    space = cache.filter(F.col("embedding_fingerprint") == fingerprint).select(
        "content_hash", "embedding", "embedding_fingerprint")
    return chunks.join(space, "content_hash", "left").withColumn(
        "technical_status", F.when(F.col("embedding").isNull(), "bm25_only").otherwise("embedded"))
