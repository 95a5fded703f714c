"""Reading files of any supported format into units, one row per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinstone import fixed_values as fv
from veinstone.functions import text as tx
from veinstone.functions.batches import pieces
from veinstone.operators.catalog import file_suffix
from veinstone.operators.chunking import ARROW_UNITS, UNIT, markdown_units, unit
from veinstone.sources import office

PARSED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("units", T.ArrayType(UNIT)),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])
TEXT_SUFFIXES, MARKDOWN = (".txt",), (".md", ".markdown")
READERS = {
    ".docx": office.read_docx, ".xlsx": office.read_xlsx, ".xlsm": office.read_xlsx,
    ".html": lambda data: office.read_html(data.decode("utf-8", "replace")),
    ".htm": lambda data: office.read_html(data.decode("utf-8", "replace")),
    ".csv": lambda data: office.read_csv(data.decode("utf-8-sig", "replace")),
}
EMPTY = "the file holds no text (images would have to be recognised first)"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "content")


def unsupported(suffix: Column) -> Column:
    """Why a suffix cannot be read here, null where it can."""
    return F.when(suffix == ".one", "notebooks cannot be read; save them as a document or page first").when(
        ~suffix.isin(*fv.SUPPORTED_SUFFIXES), F.concat(F.lit("unsupported file type: "), suffix)).when(
        suffix.isin(".doc", ".xls"), "old binary office formats need a converter, and none is installed").when(
        suffix == ".pdf", "no PDF text extractor is installed")


def parse_files(files: DataFrame) -> DataFrame:
    """(path, units, warnings, error) of (path, content); a bad file only fails itself.

    Text and Markdown are parsed by Spark expressions, container formats by
    their readers in Arrow batches.
    """
    marked = files.withColumn("suffix", file_suffix(F.col("path"))).withColumn(
        "error", unsupported(F.col("suffix")))
    none = F.array().cast("array<string>")
    text = F.try_validate_utf8("content")
    broken = marked.filter(F.col("error").isNotNull()).select(
        "path", F.array().cast(T.ArrayType(UNIT)).alias("units"), none.alias("warnings"), "error")
    plain = marked.filter(F.col("suffix").isin(*TEXT_SUFFIXES, *MARKDOWN)).withColumn(
        "text", F.coalesce(text, _replaced(F.col("content"))))
    native = plain.select("path", F.when(
        F.col("suffix").isin(*MARKDOWN), markdown_units(F.when(F.col("suffix").isin(*MARKDOWN), F.col("text")))).otherwise(
        F.array(unit(F.col("text")))).alias("units"), none.alias("warnings"),
        F.lit(None).cast("string").alias("error"))
    containers = marked.filter(F.col("suffix").isin(*READERS)).select("path", "suffix", "content")
    parsed = containers.mapInArrow(_read_containers, PARSED)
    return _without_empty(native.unionByName(parsed)).unionByName(broken)


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda c: c.decode("utf-8", "replace"), na_action="ignore")


def _replaced(content: Column) -> Column:
    """Bytes that are no valid UTF-8, with replacement characters."""
    return _decode(F.when(F.try_validate_utf8(content).isNull(), content))


def _read_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.string(), ARROW_UNITS, pa.list_(pa.string()), pa.string()
    for batch in batches:
        for part in pieces(*[batch.column(c) for c in ("content", "path", "suffix")]):
            rows = []
            for content, path, suffix in zip(*[c.to_pylist() for c in part], strict=True):
                try:
                    units, warnings = READERS[suffix](content)
                    rows.append((path, units, warnings, None))
                except Exception as problem:  # reported with its file
                    rows.append((path, [], [], f"{type(problem).__name__}: {problem}"))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=PARSED.fieldNames())


def _without_empty(parsed: DataFrame) -> DataFrame:
    filled = parsed.withColumn("units", F.filter("units", lambda u: tx.strip(u["text"]) != ""))
    return filled.withColumn("error", F.coalesce("error", F.when(F.size("units") == 0, EMPTY)))


def parse_html(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, units) of HTML held in a column."""
    schema = T.StructType([pages.schema[key], T.StructField("units", T.ArrayType(UNIT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for markups, keys in pieces(batch.column(1), batch.column(0)):
                units = [office.read_html(m)[0] for m in markups.to_pylist()]
                yield pa.RecordBatch.from_arrays([keys, pa.array(units, ARROW_UNITS)], names=[key, "units"])

    return pages.select(key, markup).mapInArrow(run, schema)


# ------------------------------------------------------------------ objects
def store_objects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New immutable objects (object_key, data, sha256) to append.

    Storing equal bytes again changes nothing; different bytes under a known
    key are an error.
    """
    hashed = incoming.withColumn("sha256", F.sha2("data", 256))
    keys = hashed.select("object_key", "sha256").distinct()
    several = keys.groupBy("object_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    known = existing.select("object_key", F.col("sha256").alias("_known"))
    judged = keys.join(known, "object_key", "left").join(several, "object_key", "left")
    clash = F.col("_n").isNotNull() | (F.col("_known") != F.col("sha256"))
    refuse = F.raise_error(F.concat(F.lit("immutable object collision at "), F.col("object_key").cast("string")))
    new = F.when(F.coalesce(clash, F.lit(False)), refuse.cast("boolean")).otherwise(F.col("_known").isNull())
    # keys are judged without their bytes; only new objects are moved
    chosen = judged.filter(new).select("object_key", "sha256")
    return hashed.join(chosen, ["object_key", "sha256"], "left_semi").dropDuplicates(["object_key", "sha256"]).select(
        "object_key", "data", "sha256")


def resolve_path(root: str, path: str) -> str:
    """``path`` below ``root``; leaving the root is an error."""
    import posixpath

    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, path))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError("storage path escapes the configured root")
    return full


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object per non-blank line."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file; what it is made of runs in its own tasks."""
    report.repartition(1).write.mode("overwrite").json(path)


def load_models(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The model registry as a table; an empty one is an error."""
    if not rows:
        raise ValueError("no models are configured")
    return spark.createDataFrame(
        [(r["id"], r["tier"], r["quota_tokens"], r["priority"], r["enabled"], r["stable"]) for r in rows],
        "model_id string, tier string, quota_tokens bigint, priority int, enabled boolean, stable boolean")


def normalized_artifact(parsed: DataFrame) -> DataFrame:
    """The parsed units as one JSON document per file, with its hash and size."""
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), "warnings", "units"),
                     {"ignoreNullFields": "false"})
    return parsed.select("path", body.alias("artifact")).withColumns({
        "sha256": F.sha2("artifact", 256), "byte_size": F.octet_length("artifact")})
