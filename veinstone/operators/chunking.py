"""Cutting parsed units into chunks of bounded token size.

A document is one row holding its units; everything happens on that row, so
chunking needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone import fixed_values as fv
from veinstone.config import EngineConfig
from veinstone.functions import text as tx
from veinstone.functions.batches import pieces
from veinstone.functions.cutting import unit_contents
from veinstone.functions.hashing import chunk_id, content_hash, record_hash

UNIT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("heading_path", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("cell_range", T.StringType()),
    T.StructField("is_table", T.BooleanType()),
])
#: Units of one document, in Arrow.
ARROW_UNITS = pa.list_(pa.struct([(f.name, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[
    f.dataType.simpleString()]) for f in UNIT]))


def chunk_documents(documents: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row per chunk of (version_id, units); the other columns are kept.

    Ordinals run over all units of a version; ids and neighbour links come
    from the array itself.
    """
    keep = [c for c in documents.columns if c != "units"]
    cut = documents.withColumn("_contents", unit_contents(
        F.transform("units", lambda u: u["text"]), F.transform("units", lambda u: u["is_table"]), config))
    cut = cut.withColumn("_chunks", F.flatten(F.zip_with("units", "_contents", lambda u, texts: F.transform(
        texts, lambda text: F.struct(
            text.alias("content"), content_hash(text).alias("content_hash"),
            *[u[f].alias(f) for f in ("heading_path", "page_number", "sheet_name", "cell_range")])))))
    named = cut.withColumn("_ids", F.transform("_chunks", lambda c, i: chunk_id(
        F.col("version_id"), i, c["content_hash"])))
    rows = named.select(*keep, "_ids", F.posexplode("_chunks").alias("ordinal", "_c"))
    at = F.col("ordinal")
    return rows.select(
        *keep, "ordinal", F.get("_ids", at).alias("chunk_id"), "_c.*",
        F.get("_ids", at - 1).alias("previous_chunk_id"),
        F.get("_ids", at + 1).alias("next_chunk_id"),
    ).withColumns({
        "token_count": tx.estimate_tokens(F.col("content")),
        "record_hash": record_hash(*[F.col(c) for c in (
            "content", "heading_path", "page_number", "sheet_name", "cell_range")])})


def unit(text: Column, heading_path: Column | None = None) -> Column:
    none = F.lit(None)
    values = {"text": text, "heading_path": none if heading_path is None else heading_path,
              "page_number": none, "sheet_name": none, "cell_range": none, "is_table": F.lit(False)}
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in UNIT.fields])


_HEADING = re.compile("(#+) ")


def _sections(text: str | None) -> list[tuple] | None:
    """Units of a Markdown text, each line read once."""
    if text is None:
        return None
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    units, path, lines = [], [], []

    def flush():
        body = "\n".join(lines)
        if body.strip(fv.SPACE):
            units.append((body, " > ".join(path), None, None, None, False))
        lines.clear()

    for line in plain.removesuffix("\n").split("\n"):
        bare = line.strip(fv.SPACE)
        heading = _HEADING.match(bare)
        if heading:
            flush()
            level = len(heading[1])
            path = [*path[:level - 1], bare[level:].strip(fv.SPACE)]
        else:
            lines.append(line)
    flush()
    return units


@F.arrow_udf(T.ArrayType(UNIT))
def _markdown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (part,) in pieces(batch):
            yield pa.array([_sections(t) for t in part.to_pylist()], ARROW_UNITS)


def markdown_units(text: Column) -> Column:
    """Units of a Markdown text: the lines under each heading, with its heading path.

    A heading needs a space after its hashes; a skipped level does not pad the
    path.
    """
    return _markdown(text)
