"""How the library touches the cluster: size-checked broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Rows of a partition that ``in_parts`` makes.
PART_ROWS = 250_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` provably has at most ``max_rows`` rows (reads no further)."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that is usually small.

    Its size is checked first: within the bound it is broadcast and ``big`` is
    not shuffled; beyond it the join shuffles and adaptive execution splits
    skewed keys.
    """
    return big.join(F.broadcast(small) if is_small(small, max_rows) else small, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work on few input files one partition per task slot.

    Input with at least one split per slot (large files have many) is left as it is: no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, *keys)


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by key in partitions whose number grows with ``rows``.

    What a task sorts then does not grow with the input, as it does where the number of shuffle partitions
    is fixed. Small input has one partition per task slot.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(slots, -(-rows // PART_ROWS)), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    Column pruning and filters still reach the files, and a lost executor only
    re-reads them.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named
