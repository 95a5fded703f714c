"""Vector expressions and the offline feature-hash embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone import fixed_values as fv
from veinstone.functions.batches import pieces


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


_FEATURE = re.compile(fv.FEATURE_TOKEN)
_CJK_RUN = re.compile(f"[{fv.CJK}]+")
_SLOTS: dict[str, int] = {}
#: Texts whose vectors are made at once.
TEXT_STEP = 256


def _slot(feature: str) -> int:
    slot = _SLOTS.get(feature)
    if slot is None:
        digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
        slot = int.from_bytes(digest, "big")
        if len(_SLOTS) < 200_000:
            _SLOTS[feature] = slot
    return slot


def feature_hash(text: str, dimensions: int) -> np.ndarray:
    """Signed feature hashing of words and CJK bigrams, L2 normalised."""
    return feature_hashes([text], dimensions)[0]


def feature_hashes(texts: list[str], dimensions: int) -> np.ndarray:
    """The vectors of some texts, one a row, counted together."""
    slots, n = [], []
    for text in texts:
        folded = text.casefold()
        features = _FEATURE.findall(folded)
        for run in _CJK_RUN.findall(folded):
            features += [run[i:i + 2] for i in range(max(1, len(run) - 1))]
        slots += map(_slot, features)
        n.append(len(features))
    slot = np.array(slots, np.uint64)
    cell = np.repeat(np.arange(len(texts)) * dimensions, n) + (slot % np.uint64(dimensions)).astype(np.int64)
    sign = np.where(slot >> np.uint64(10) & np.uint64(1), 1.0, -1.0)
    vectors = np.bincount(cell, sign, len(texts) * dimensions).reshape(len(texts), dimensions)
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(lengths == 0, 1.0, lengths)


def _embedded(texts: list[str | None], dimensions: int) -> pa.Array:
    known = [t for t in texts if t is not None]
    values = [feature_hashes(known[i:i + TEXT_STEP], dimensions).astype("float32").ravel() for i in range(0, len(known), TEXT_STEP)]
    has = np.array([t is not None for t in texts], bool)
    offsets = np.append(0, np.cumsum(has * dimensions)).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, "float32")),
                                    mask=pa.array(~has))


def feature_hash_embedding(text: Column, dimensions: int) -> Column:
    """Arrow-batched embedding column; the default when no model is plugged in."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (part,) in pieces(batch):
                yield _embedded(part.to_pylist(), dimensions)

    return embed(text)


def embedding_or_error(text: Column, dimensions: int, embed=feature_hash) -> Column:
    """``struct<vector, error>``: a text that the model port fails on is a row with an error, not a failed job.

    ``embed`` is a function of (text, dimensions); a vector of another length is an error, too.
    """
    @F.pandas_udf("vector array<float>, error string")
    def run(batch: pd.Series) -> pd.DataFrame:
        vectors, errors = [], []
        for t in batch:
            vector = error = None
            if t is not None:
                try:
                    vector = np.asarray(embed(t, dimensions), "float32")
                    if len(vector) != dimensions:
                        vector, error = None, f"embedding dimension mismatch: {len(vector)}"
                except Exception as problem:  # whatever a model may raise is told with its question
                    vector, error = None, f"{type(problem).__name__}: {problem}"
            vectors.append(vector)
            errors.append(error)
        return pd.DataFrame({"vector": vectors, "error": errors})

    return run(text)
