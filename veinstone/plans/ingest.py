"""Files to searchable chunks: parse, chunk, embed once per content, project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.cluster import cut_lineage
from veinstone.config import EngineConfig
from veinstone.operators.chunking import chunk_documents
from veinstone.operators.embedding import attach_embeddings, embed_missing
from veinstone.operators.lexical import search_projection
from veinstone.sources.files import parse_files


def ingest(files: DataFrame, catalog: DataFrame, cache: DataFrame, config: EngineConfig
           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with vectors, new cache rows, failed files).

    ``files``: path, content.  ``catalog``: path and the version and document
    columns of each file.  Chunks of one version carry ``technical_status``
    embedded or bm25_only.
    """
    parsed = cut_lineage(parse_files(files))
    good = parsed.filter(F.col("error").isNull()).join(catalog, "path")
    chunks = cut_lineage(chunk_documents(good.drop("warnings", "error"), config))
    fresh = cut_lineage(embed_missing(chunks, cache, config))
    known = cache.select(*fresh.columns).unionByName(fresh)
    attached = attach_embeddings(chunks, known, config.embedding_fingerprint)
    failed = parsed.filter(F.col("error").isNotNull()).select("path", "error")
    return search_projection(cut_lineage(attached)), fresh, failed
