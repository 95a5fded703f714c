"""Reranking of bounded candidate pools with the offline scorer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.functions.vectors import feature_hash
from veinstone.operators.fusion import rerank_by


def passage() -> Column:
    """What a reranker reads: governance metadata, then the content."""
    shown = [F.concat(F.lit(label), F.coalesce(F.col(column), F.lit("")))
             for label, column in (("file=", "filename"), ("status=", "lifecycle_status"),
                                   ("version=", "version_label"), ("heading=", "heading_path"))]
    return F.concat_ws("\n", *shown, F.coalesce("content", F.lit("")))


def rerank(pool: DataFrame, query: str, signals: str, top_n: int, dimensions: int) -> DataFrame:
    """Feature-hash cosine plus 10 per contained signal; ties keep pool order."""
    @F.pandas_udf(T.DoubleType())
    def score(asked: pd.Series, passages: pd.Series, wanted: pd.Series) -> pd.Series:
        known = {q: feature_hash(q, dimensions) for q in set(asked)}
        return pd.Series([
            float(known[q] @ feature_hash(p, dimensions))
            + 10.0 * sum(s in p.casefold() for s in w)
            for q, p, w in zip(asked, passages, wanted)])

    scored = pool.withColumn("score", F.round(score(F.col(query), passage(), F.col(signals)), 9))
    ranked = rerank_by(scored, F.desc("score"), "rank")
    return ranked.filter(F.col("rank") <= top_n)
