"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.common import Cuts

_HIT = "query_id long, vec_id long, score double"
_HIT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
CHUNK = 8192


class RotatedCodes:
    """Binary codes: centred unit vectors, turned by a learned rotation, one bit for each axis.

    The rotation alternates between the nearest signs and the best rotation towards them, starting
    from the principal axes, so that the bits lose as little of the vectors as they can.
    """

    def __init__(self, sample: np.ndarray, rounds: int = 25, seed: int = 3):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0)
        centred, dims = unit - self.mean, unit.shape[1]
        _, axes = np.linalg.eigh(centred.T @ centred)
        turned = centred @ axes
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
        for _ in range(rounds):
            signs = np.where(turned @ rotation > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ turned)
            rotation = (u @ v).T
        self.turn = axes @ rotation

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return (unit - self.mean) @ self.turn > 0


def substrings(bits: np.ndarray, parts: int) -> np.ndarray:
    """Each row's bits as ``parts`` numbers of about equal length (at most 16 bits)."""
    return np.stack([part @ (1 << np.arange(part.shape[1])) for part in np.array_split(bits, parts, axis=1)], 1).astype(np.uint16)


def probes(length: int, radius: int) -> np.ndarray:
    """All differences of a substring within a Hamming radius."""
    return np.array([sum(1 << i for i in flips) for r in range(min(radius, length) + 1)
                     for flips in itertools.combinations(range(length), r)], np.uint16)


class MultiIndex:
    """One table of buckets for each substring of the codes of a block of vectors."""

    def __init__(self, codes: np.ndarray, lengths: list[int]):
        self.codes, self.lengths = codes, lengths
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange((1 << n) + 1)) for j, (o, n) in enumerate(zip(self.order, lengths, strict=True))]

    def within(self, code: np.ndarray, radius: int, masks: list[np.ndarray]) -> np.ndarray:
        """Rows whose whole code differs from ``code`` in at most ``radius`` bits.

        By the pigeonhole principle such a row is, in some substring, within that substring's share of
        the radius, so the buckets within the shares hold every one of them.
        """
        seen = np.zeros(len(self.codes), bool)
        for j, mask in enumerate(masks):
            if not len(mask):
                continue
            bucket = (mask ^ code[j]).astype(np.int64)
            low, high = self.starts[j][bucket], self.starts[j][bucket + 1]
            n = high - low
            full = n > 0
            low, n = low[full], n[full]
            if len(n):
                at = np.arange(n.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                seen[self.order[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def shares(radius: int, parts: int) -> list[int]:
    """Radius of each substring: with radius = parts * r + a, r for the first a + 1 and r - 1 for the others."""
    r, a = divmod(radius, parts)
    return [r if j <= a else r - 1 for j in range(parts)]


def exact_scores(query: np.ndarray, norm: float, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines in double precision; the sum of a row does not depend on the rows around it."""
    return (vectors * query).sum(1) / (norms * norm)


def _search(model, parts, radius, k, ids, vectors):
    """A task: index its vectors in blocks, search every query of the block of queries, keep the best k."""
    dims = vectors.shape[1]
    lengths = [len(x) for x in np.array_split(np.arange(dims), parts)]
    masks = [probes(n, r) if r >= 0 else np.zeros(0, np.uint16) for n, r in zip(lengths, shares(radius, parts), strict=True)]
    q_norm = np.sqrt((vectors * vectors).sum(1))
    q_codes = substrings(model.bits(vectors), parts)

    def run(batches):
        best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        best = np.full((len(ids), k), -np.inf)
        held, size = [], 0

        def block():
            nonlocal held, size
            own = np.concatenate([h[0] for h in held])
            floats = np.concatenate([h[1] for h in held])
            held, size = [], 0
            index = MultiIndex(substrings(model.bits(floats), parts), lengths)
            norms = np.sqrt((floats * floats).sum(1))
            for i in range(len(ids)):
                rows = index.within(q_codes[i], radius, masks)
                rows = rows[own[rows] != ids[i]]
                if not len(rows):
                    continue
                score = exact_scores(vectors[i], q_norm[i], floats[rows], norms[rows])
                score = np.concatenate([best[i], score])
                who = np.concatenate([best_ids[i], own[rows]])
                if len(score) > 4 * k:  # all that reach the k-th best, ties included
                    reach = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    score, who = score[reach], who[reach]
                top = np.lexsort((who, -score))[:k]
                best[i], best_ids[i] = score[top], who[top]

        for batch in batches:
            rows = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dims)
            held.append(rows)
            size += len(rows[0])
            if size >= CHUNK:
                block()
        if size:
            block()
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, k)[found.ravel()]), pa.array(best_ids[found]), pa.array(best[found])], schema=_HIT_ARROW)

    return run


def usable(embeddings: DataFrame, dims: int) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0))


def calibrated_radius(model: RotatedCodes, sample: np.ndarray, k: int, reach: float) -> int:
    """The Hamming radius that holds ``reach`` of the k nearest inside the sample.

    All rows hold nearer neighbours than a sample of them, so the reach over all rows is higher.
    """
    queries = sample[:: max(1, len(sample) // 200)]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    bits = model.bits(sample)
    distances = []
    for q in queries:
        score = unit @ (q / np.linalg.norm(q))
        near = np.argsort(-score)[1:k + 1]
        code = model.bits(q[None])[0]
        distances += list((bits[near] != code).sum(1))
    return int(np.quantile(distances, reach, method="higher")) if distances else sample.shape[1]


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, parts: int = 4, reach: float = 0.99,
            training_rows: int = 20_000, query_block: int = 8192, cuts: Cuts | None = None) -> DataFrame:
    """The k nearest rows by cosine of every row whose vec_id is divisible by ``every``.

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id. Vectors that are null, zero or
    hold null or non-finite components, rows without vec_id, and vectors of another length than most
    have, take no part; empty tables give no rows. Rows that repeat a vec_id are candidates each, and the
    smallest of their vectors is the query; a query's own vec_id is never its candidate.

    Codes and radius are learned from at most ``training_rows`` rows (chosen by hash). Vectors stay
    where they are: each task indexes them in blocks and searches queries, which come in blocks of at
    most ``query_block`` (a bound on what is broadcast), so duplicates of one vector meet no single
    task. Queries with fewer than k hits are searched again without a radius.
    """
    cuts = cuts or Cuts(embeddings.sparkSession)
    sizes = (embeddings.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count()
             .orderBy(F.desc("count"), "n").limit(1).collect())
    if not sizes or not sizes[0].n:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cuts.keep(usable(embeddings, sizes[0].n))
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(training_rows).select("embedding").collect()
    if not sampled:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.embedding for r in sampled], np.float64)
    model = RotatedCodes(sample)
    dims = sample.shape[1]
    parts = max(parts, -(-dims // 16))
    radius = calibrated_radius(model, sample, k, reach)

    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    best = _passes(cuts, rows, queries, model, parts, radius, k, query_block)
    if radius < dims:
        short = queries.join(best.groupBy("query_id").count().withColumnRenamed("query_id", "vec_id"), "vec_id", "left").filter(
            F.coalesce("count", F.lit(0)) < k).select("vec_id", "embedding")
        again = _passes(cuts, rows, short, model, parts, dims, k, query_block)
        best = best.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return best.select("query_id", "rank", "vec_id", "score")


def _passes(cuts, rows, queries, model, parts, radius, k, query_block):
    """Ranks of all queries, one pass over the vectors for each block of queries."""
    n = queries.count()
    blocks = 1 if n <= query_block else -(-2 * n // query_block)  # hashed blocks are uneven
    queries = cuts.keep(queries.withColumn("_block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))))
    hits = None
    for b in range(blocks):
        block = queries.filter(F.col("_block") == b).orderBy("vec_id", "embedding").collect()
        if not block:
            continue
        ids = np.array([r.vec_id for r in block], np.int64)
        vectors = np.array([r.embedding for r in block], np.float64)
        found = cuts.keep(rows.mapInArrow(_search(model, parts, radius, k, ids, vectors), _HIT))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
