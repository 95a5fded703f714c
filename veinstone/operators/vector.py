"""Exact cosine top-k for many questions over a partitioned vector column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone.cluster import cut_lineage, is_small, join_small
from veinstone.functions import vectors as vx
from veinstone.operators.lexical import top_per_query

QUERY_BLOCK = 4096
SCORE_DIGITS = 6


def fingerprint_gate(index: DataFrame, fingerprint: str) -> DataFrame:
    """Rows embedded in the current vector space."""
    return index.filter(F.col("embedding").isNotNull()
                        & (F.col("embedding_fingerprint") == fingerprint))


def cosine_topk(index: DataFrame, vector: list[float], k: int,
                min_similarity: float | None = None) -> DataFrame:
    """One question: the vector is a literal, the plan a single top-k scan."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    scored = index.withColumn("score", F.round(vx.cosine(F.col("embedding"), literal), SCORE_DIGITS))
    if min_similarity is not None:
        scored = scored.filter(F.col("score") >= min_similarity)
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_search(index: DataFrame, queries: DataFrame, k: int,
                  min_similarity: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` rows per question; ``queries`` has (query_id, vector) and may
    have ``project_ids``.

    Each task multiplies its Arrow batches with a block of question vectors
    and keeps its own best ``k`` per question, so neither all pairs nor the
    vectors are ever shuffled.  More questions than one block are answered
    block by block, each block in its own scan.
    """
    if is_small(queries, block):
        parts = [queries]
    else:
        n_blocks = queries.count() // block + 1
        placed = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        parts = [placed.filter(F.col("_block") == b).drop("_block") for b in range(n_blocks)]
    found = [_search_block(index, part, k, min_similarity) for part in parts]
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    ranked = cut_lineage(top_per_query(union, k, F.desc("score"), F.asc("chunk_id")))
    kept = [c for c in index.columns if c != "embedding"]
    return join_small(index.select(*kept), ranked, "chunk_id").select("query_id", *kept, "score", "rank")


def _best(query: np.ndarray, score: np.ndarray, chunk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each question by score, then chunk id; and the place of each in that order."""
    order = np.lexsort((chunk, -score, query))
    query, score, chunk = query[order], score[order], chunk[order]
    start = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(start, np.arange(len(query)), 0)) if len(query) else query
    kept = place < k
    return query[kept], score[kept], chunk[kept], place[kept]


def _search_block(index: DataFrame, queries: DataFrame, k: int, min_similarity) -> DataFrame:
    """(query_id, chunk_id, score): each task's own best ``k`` rows for every question of a block."""
    asked = queries.toArrow()
    ids = asked.column("query_id").combine_chunks()
    listed = np.array(asked.column("vector").to_pylist(), dtype="float64")
    matrix = listed.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(lengths == 0, 1.0, lengths)
    projects = asked.column("project_ids").to_pylist() if "project_ids" in queries.columns else []
    scoped = ["project_id"] if any(projects) else []
    shared = index.sparkSession.sparkContext.broadcast((matrix, ids, projects))
    schema = T.StructType([queries.schema["query_id"], index.schema["chunk_id"], T.StructField("score", T.DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors_of, names, allowed_in = shared.value
        if not len(names):
            return
        floor = np.full(len(names), -np.inf if min_similarity is None else min_similarity)
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1"))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            rows = vectors.reshape(batch.num_rows, -1).astype("float64")
            lengths = np.linalg.norm(rows, axis=1, keepdims=True)
            scores = np.round((rows / np.where(lengths == 0, 1.0, lengths)) @ vectors_of.T, SCORE_DIGITS)
            if scoped:  # a question may be limited to some projects
                place = batch.column("project_id").to_numpy(zero_copy_only=False)
                for column, allowed in enumerate(allowed_in):
                    if allowed:
                        scores[~np.isin(place, allowed), column] = -np.inf
            if batch.num_rows > k:  # ties with the k-th stay in
                floor = np.maximum(floor, np.partition(scores, -k, axis=0)[-k])
            row, query = np.nonzero((scores >= floor) & np.isfinite(scores))
            chunk = np.array(batch.column("chunk_id").to_pylist(), "U")[row]
            *held, place = _best(*(np.concatenate(x) for x in zip(held, (query, scores[row, query], chunk), strict=True)), k)
            last = place == k - 1
            floor[held[0][last]] = np.maximum(floor[held[0][last]], held[1][last])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(held[0])), pa.array(held[2], pa.string()), pa.array(held[1])],
                                             names=schema.fieldNames())

    return index.select("chunk_id", "embedding", *scoped).mapInArrow(search, schema)
