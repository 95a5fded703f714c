"""A stored vector index: rows partitioned by their nearest centroid, probed until the rest is out of reach.

The angle between a question and a row is at least the angle to the row's centroid less the widest angle
of the centroid's cell, so the cells that a search leaves out are proven to hold no better row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.cluster import cut_lineage
from veinstone.operators.lexical import top_per_query
from veinstone.operators.vector import SCORE_DIGITS

#: Rows that train the centroids, most cells, rounds of training, cells a question probes first.
SAMPLE, CELLS, ROUNDS, PROBES = 20_000, 1024, 12, 4
#: Half a unit of the last digit of a score, and room for float arithmetic.
SLACK = 0.5 * 10.0 ** -SCORE_DIGITS + 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def train_centroids(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of a sample of about ``sample`` rows, chosen by a hash of their ids at any size of
    the table: that many vectors reach the driver."""
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    chosen = rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = chosen.orderBy("chunk_id").select("embedding").toArrow().column("embedding").to_pylist()
    points = _unit(np.array(found, float)) if found else np.zeros((1, 1))
    k = min(cells or CELLS, max(1, int(n ** 0.5)), len(points))
    picked = np.random.default_rng(7).permutation(len(points))[:k]
    centroids = points[picked]
    for _ in range(ROUNDS):
        nearest = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        filled = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(filled[:, None], _unit(sums), centroids)
    return centroids


def write_vectors(rows: DataFrame, folder: str, cells: int | None = None) -> None:
    """Store (chunk_id, embedding, ...) partitioned by cell. Rows without a usable vector are left out:
    null, empty, zero, or with a component that is null or not finite."""
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(usable)
    spark, centroids = rows.sparkSession, train_centroids(rows, cells)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            vectors = _unit(np.array(batch.column("embedding").to_pylist(), float).reshape(batch.num_rows, -1))
            near = vectors @ shared.value.T
            cell = np.argmax(near, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.clip(near[np.arange(len(cell)), cell], -1, 1)), pa.array(cell, pa.int32())],
                names=[*batch.schema.names, "to_centroid", "cell"])

    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + ["to_centroid double", "cell int"])
    placed = rows.mapInArrow(assign, schema)
    # a cell that holds many rows spreads over several tasks
    placed.repartitionByRange("cell", F.xxhash64("chunk_id")).write.partitionBy("cell").parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("to_centroid").alias("edge")).join(known, "cell").write.parquet(
        f"{folder}/cells")


class VectorIndex:
    """What is stored below ``folder``; the cells (at most ``CELLS``) are held by the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.rows = spark.read.parquet(f"{folder}/rows")
        cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
        self.cells = np.array([c.cell for c in cells], int)
        self.size = np.array([c.n for c in cells], int)
        self.centroids = np.array([c.centroid for c in cells], float).reshape(len(cells), -1)
        self.radius = np.arccos(np.clip([c.edge for c in cells], -1, 1))

    def reach(self, questions: np.ndarray) -> np.ndarray:
        """The greatest cosine that a row of each cell can have with each question."""
        angle = np.arccos(np.clip(questions @ self.centroids.T, -1, 1))
        return np.cos(np.maximum(0.0, angle - self.radius))


def _probe(index: VectorIndex, wanted: np.ndarray, questions: np.ndarray, ids: pa.Array, id_type: str, k: int,
           least: np.ndarray) -> DataFrame:
    """(query_id, chunk_id, score) of the best rows of the ``wanted`` (question, cell) pairs: partitions
    that no question wants are not read, and each task keeps the best k of what it has seen."""
    spark = index.rows.sparkSession
    listed = spark.sparkContext.broadcast(
        ({int(index.cells[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}, questions, ids, least))
    rows = index.rows.filter(F.col("cell").isin([int(c) for c in index.cells[wanted.any(axis=0)]]))

    def run(batches):
        per_cell, matrix, names, floor = listed.value
        best: list = [(np.zeros(0), []) for _ in range(len(matrix))]
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            vectors = _unit(np.array(batch.column("embedding").to_pylist(), float).reshape(batch.num_rows, -1))
            chunk = np.array(batch.column("chunk_id").to_pylist(), object)
            for c in np.unique(cell):
                inside = cell == c
                scores = np.round(vectors[inside] @ matrix[per_cell[int(c)]].T, SCORE_DIGITS)
                for column, q in enumerate(per_cell[int(c)]):
                    good = scores[:, column] >= floor[q]
                    value = np.concatenate([best[q][0], scores[good, column]])
                    name = [*best[q][1], *chunk[inside][good]]
                    order = sorted(range(len(name)), key=lambda i: (-value[i], name[i]))[:k]
                    best[q] = (value[order], [name[i] for i in order])
        asked = [q for q, (value, _) in enumerate(best) for _ in value]
        if asked:
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(asked)), pa.array([n for _, name in best for n in name], pa.string()),
                 pa.array(np.concatenate([value for value, _ in best]))], names=["query_id", "chunk_id", "score"])

    return rows.select("cell", "chunk_id", "embedding").mapInArrow(run, f"query_id {id_type}, chunk_id string, score double")


def index_search(index: VectorIndex, queries: DataFrame, k: int, min_similarity: float | None = None,
                 probes: int = PROBES, proven: bool = True) -> tuple[DataFrame, float]:
    """Best ``k`` rows per question (query_id, rank, chunk_id, score), and the share of rows that was read.

    The cells of the ``probes`` nearest centroids give a question its k-th score; with ``proven`` every other cell
    whose reach is not below that score (or ``min_similarity``) is read too, so the result is that of a
    full scan. Without it the search is approximate. ``queries`` (query_id, vector) is one block of
    questions, held by the driver.
    """
    asked = queries.toArrow()
    ids = asked.column("query_id").combine_chunks()
    matrix = _unit(np.array(asked.column("vector").to_pylist(), float).reshape(len(ids), -1))
    least = np.full(len(ids), -np.inf if min_similarity is None else min_similarity)
    reach, id_type = index.reach(matrix), dict(queries.dtypes)["query_id"]
    first = np.zeros(reach.shape, bool)
    nearest = np.argsort(-(matrix @ index.centroids.T), axis=1, kind="stable")[:, :probes]
    np.put_along_axis(first, nearest, True, axis=1)
    first &= reach >= least[:, None] - SLACK
    found = cut_lineage(_probe(index, first, matrix, ids, id_type, k, least))
    read = first
    if proven:
        kth = {r.query_id: r.score for r in top_per_query(found, k, F.desc("score"), F.asc("chunk_id")).filter(
            F.col("rank") == k).select("query_id", "score").collect()}
        floor = np.array([max(least[i], kth.get(q, -np.inf)) for i, q in enumerate(ids.to_pylist())])
        rest = ~first & (reach >= floor[:, None] - SLACK)
        if rest.any():
            found = found.unionByName(_probe(index, rest, matrix, ids, id_type, k, floor))
            read = first | rest
    share = float(index.size[read.any(axis=0)].sum() / max(1, index.size.sum()))
    return top_per_query(found, k, F.desc("score"), F.asc("chunk_id")), share
