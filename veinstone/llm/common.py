"""Shared helpers: written cuts that can be dropped again, words, global order, linked components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.cluster import shared_folder

#: Fixed value: a word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


class Cuts:
    """Tables written to the shared checkpoint folder, so that lost executors only re-read files.

    ``keep`` writes a table and returns a reader of it; ``drop`` deletes one that is no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = [*getattr(self, "_held", []), out]  # ids stay unique while the object lives
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(table)])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def first_by_hash(rows: DataFrame, limit: int, *key: str) -> list:
    """The ``limit`` rows with the smallest hashes of ``key`` (ties by ``key``), collected.

    How many rows have which leading 16 bits of the hash tells how far the choice goes, so the tasks send
    about ``limit`` rows in all, at any number of tasks, instead of ``limit`` each.
    """
    marked = rows.withColumn("_hash", F.xxhash64(*key))
    top = F.shiftright("_hash", 48)
    counts = sorted((r.top, r["count"]) for r in marked.groupBy(top.alias("top")).count().collect())
    edge, seen = None, 0
    for edge, n in counts:  # noqa: B007
        seen += n
        if seen >= limit:
            break
    if edge is None:
        return []
    return marked.filter(top <= edge).orderBy("_hash", *key).limit(limit).drop("_hash").collect()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def group_key(value: Column) -> Column:
    """A string that tells null from every text, so that plain equi-joins keep null groups."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def with_position(cuts: Cuts, df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``position`` (from 0) in the global order of ``order`` without one task seeing all rows.

    Rows are range-partitioned and written; then each range counts its rows, and positions inside a
    range start at the sum of the ranges before it.
    """
    ranged = cuts.keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (ranged.withColumn("_inside", F.row_number().over(inside))
            .join(starts, "_range")
            .withColumn("position", F.col("_start") + F.col("_inside") - 1)
            .drop("_range", "_start", "_inside"))


def components(cuts: Cuts, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): nodes have equal components when linked.

    Each round merges every node with the smallest node two steps down its smallest neighbours and
    contracts the edges; nodes at least halve, so the rounds grow with the logarithm of the longest
    path. Hot nodes are pre-aggregated by ``min``.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cuts.keep(both.filter("a <> b").distinct())
    label = cuts.keep(edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        low = cuts.keep(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        down = low.select(F.col("a").alias("p"), F.col("p").alias("to"))
        step = cuts.keep(low.join(down, "p").select("a", "to"))
        other = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = cuts.keep(label.join(step.withColumnRenamed("a", "component"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")))
        fewer = cuts.keep(edges.join(step, "a").join(other, "b").filter("to <> to_b").select(
            F.col("to").alias("a"), F.col("to_b").alias("b")).distinct())
        cuts.drop(edges, label, low, step)
        edges, label = fewer, moved
    cuts.drop(edges)
    return label
