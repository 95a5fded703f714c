"""Rebuilding the projection as a new generation that goes live only when it is verified.

Versions are dealt to stages. A stage is written, read back and verified by its manifests, then its
verified versions are noted; a run that broke off skips noted stages and overwrites the one it was in.
The last step switches one pointer, so readers see the old generation or the new one, never a mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators.sync import version_manifest

PROJECTED = ["version_id", "chunk_id", "ordinal", "record_hash"]
_VERIFIED = "version_id string, n_chunks long, manifest_hash string, verified boolean"


def _complete(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match and were written to the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().getName() for f in found)


def rebuild(chunks: DataFrame, folder: str, generation: int, stages: int = 4,
            project: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[int]:
    """Write the stages of a generation that are not complete yet; returns those that were written.

    ``project`` makes projection rows of chunk rows. A version's manifest is one digest of its ordered
    chunks; a version is verified when the manifest of what was stored equals that of its chunks.
    """
    spark, base = chunks.sparkSession, f"{folder}/generation={generation}"
    done, written = set(_complete(spark, f"{base}/verified/stage=*")), []
    for stage in range(stages):
        if f"stage={stage}" in done:
            continue
        mine = chunks.filter(F.pmod(F.xxhash64("version_id"), F.lit(stages)) == stage)
        project(mine).write.mode("overwrite").parquet(f"{base}/projection/stage={stage}")
        stored = version_manifest(spark.read.parquet(f"{base}/projection/stage={stage}")).select(
            "version_id", F.col("n_chunks").alias("_n"), F.col("manifest_hash").alias("_hash"))
        same = F.col("_n").eqNullSafe(F.col("n_chunks")) & F.col("_hash").eqNullSafe(F.col("manifest_hash"))
        judged = version_manifest(mine).join(stored, "version_id", "left").select(
            "version_id", "n_chunks", "manifest_hash", same.alias("verified"))
        judged.write.mode("overwrite").parquet(f"{base}/verified/stage={stage}")
        written.append(stage)
    return written


def switch(spark: SparkSession, folder: str, generation: int, stages: int = 4) -> None:
    """Make a generation the current one; every stage must be complete. One small write is the switch."""
    missing = {f"stage={s}" for s in range(stages)} - set(_complete(spark, f"{folder}/generation={generation}/verified/stage=*"))
    if missing:
        raise RuntimeError(f"generation {generation} is not complete: {', '.join(sorted(missing))}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/current/generation={generation}")


def current_generation(spark: SparkSession, folder: str) -> int | None:
    found = _complete(spark, f"{folder}/current/generation=*")
    return max((int(name.split("=")[1]) for name in found), default=None)


def verdicts(spark: SparkSession, folder: str, generation: int) -> DataFrame:
    """(version_id, n_chunks, manifest_hash, verified) of a generation."""
    return spark.read.schema(_VERIFIED).parquet(f"{folder}/generation={generation}/verified").drop("stage")


def served(spark: SparkSession, folder: str) -> DataFrame:
    """The projection rows of the current generation, without versions that were not verified."""
    generation = current_generation(spark, folder)
    if generation is None:
        raise RuntimeError("no generation is current")
    rows = spark.read.parquet(f"{folder}/generation={generation}/projection").drop("stage")
    good = verdicts(spark, folder, generation).filter("verified").select("version_id")
    return rows.join(good, "version_id", "left_semi")


def reindex(chunks: DataFrame, folder: str, generation: int, stages: int = 4,
            project: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Rebuild, switch, and return the verdict on every version."""
    rebuild(chunks, folder, generation, stages, project)
    switch(chunks.sparkSession, folder, generation, stages)
    return verdicts(chunks.sparkSession, folder, generation)
